"""op11: eight clusters of the 64-component ``embeddings``, after ten exact rounds and a last assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import centroids

NAME = "op11_centroid_clustering"
ROUNDS = 10


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), rounds=ROUNDS)


def _sql() -> str:
    """Each round's assignment (a) and centroids (c) as a pair of expressions."""
    parts = ["""v AS MATERIALIZED (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS c, v AS m FROM (SELECT v, sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h FROM v) ORDER BY h, v LIMIT 8)"]
    for i in range(ROUNDS + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS b FROM (
  SELECT r, vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM (SELECT row_number() OVER () AS r, * FROM v), c{i}) GROUP BY r, vec_id)""")
        if i < ROUNDS:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, o.m) AS m FROM c{i} o LEFT JOIN (
  SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS m FROM (
    SELECT b.c AS c, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT b, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY ALL) GROUP BY c) n USING (c))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, b.c AS cluster, b.d AS distance, sum(b.d) OVER (PARTITION BY b.c)::BIGINT AS cluster_inertia, sum(b.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON c = b.c"""


ORACLE_SQL = _sql()
