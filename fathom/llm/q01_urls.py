"""op1: every URL of ``pages`` judged by five site rules and the default patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathom.llm.url_filters import PATTERNS, judge, pattern_rule, site_rule

NAME = "op1_url_filters"
#: Fixed values of the query's contract.
SITES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = judge(pages, [site_rule(a, t) for a, t in SITES], [pattern_rule(p) for p in PATTERNS])
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    rules = ", ".join(f"('{a}', '{t.partition('/')[0]}', '/{t.partition('/')[2]}')" for a, t in SITES)
    regexes = [(r.action, r.regex.replace("'", "''")) for r in map(pattern_rule, PATTERNS)]
    any_of = lambda action: " OR ".join(f"regexp_matches(u, '{x}')" for a, x in regexes if a == action) or "FALSE"
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(action, rhost, rpath) AS (VALUES {rules}),
judged AS (
  SELECT p.*, (SELECT arg_max(struct_pack(t := r.rhost || r.rpath, a := r.action), length(r.rhost || r.rpath)) FROM rules r
     WHERE (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)) AS b
  FROM parts p)
SELECT page_id, host, path, b.t AS rule,
  CASE WHEN b IS NOT NULL THEN b.a WHEN {any_of("allow")} THEN 'allow' WHEN {any_of("block")} THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


ORACLE_SQL = _oracle()
