"""op9: all ``pages`` written to WARC archives, indexed, and read back by looking up every URL in the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import warc

NAME = "op9_warc"
#: Least bytes of payloads that are stored once.
LEAST = 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    segments = warc.build_index(warc.write(pages, LEAST))
    return warc.read(warc.look_up(warc.url_keys(pages), segments))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages),
v AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(h, (i * 5 + 1)::INT, 5))::BIGINT) AS x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(x, lambda q: substr(a, ((q >> 15) + 1)::INT, 1) || substr(a, (((q >> 10) & 31) + 1)::INT, 1)
    || substr(a, (((q >> 5) & 31) + 1)::INT, 1) || substr(a, ((q & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM v
"""
