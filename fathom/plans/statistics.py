"""Corpus statistics that a new load adds to without reading what was loaded before.

A load leaves how many documents have each of its terms, the number and the lengths of its documents, and a KLL sketch of
those lengths: states that merge by addition, or by merging sketches. Term weights after any number of loads are those of a
fit over all documents at once; quantiles of lengths are within the sketch's error, about 1.3 % of the ranks at K = 200.

Tables under ``path``: terms (load, term, df) and loads (load, num_docs, total, sketch). The row in ``loads`` is written last
and counts a load in, so a load that was cut off leaves nothing that is read, and is repeated under its name without harm.
Documents that are taken back, with their texts as they were loaded, make a load of negative numbers; sketches forget nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.tokens import tokenized
from fathom.operators import retrieval as R
from fathom.operators.layout import spread
from fathom.sinks import discard, materialized, store

K = 200


def add(docs: DataFrame, path: str, load: str, text: str = "content", taken_back: bool = False) -> bool:
    """Counts the documents in, once for each name of a load; whether it was not there already."""
    spark, sign = docs.sparkSession, -1 if taken_back else 1
    if load in loads(spark, path):
        return False
    tokens = materialized(tokenized(spread(docs.select(text)), text, "t").select(F.array_distinct("t").alias("terms"), F.size("t").cast("long").alias("dl")), "tokens")
    terms = tokens.select(F.explode("terms").alias("term")).groupBy("term").agg((sign * F.count("*")).alias("df"))
    terms.withColumn("load", F.lit(load)).write.mode("overwrite").parquet(f"{path}/terms/{_name(load)}")
    sketch = F.lit(None).cast("binary") if taken_back else F.kll_sketch_agg_bigint("dl", F.lit(K))
    totals = tokens.agg((sign * F.count("*")).alias("num_docs"), (sign * F.coalesce(F.sum("dl"), F.lit(0))).alias("total"), sketch.alias("sketch"))
    totals.withColumn("load", F.lit(load)).write.mode("overwrite").parquet(f"{path}/loads/{_name(load)}")
    discard(tokens)
    return True


def _name(load: str) -> str:
    """A folder for a load: its name, if no path is unsafe with it, is kept readable."""
    return "".join(c if c.isalnum() or c in "-_." else f"%{ord(c):x}" for c in load)


def loads(spark: SparkSession, path: str) -> set[str]:
    """Names of the loads that have been counted in: those whose totals are complete."""
    done = [n for n in store.names(spark, f"{path}/loads") if store.exists(spark, f"{path}/loads/{n}/_SUCCESS")]
    return {r["load"] for r in _totals(spark, path, done).select("load").collect()} if done else set()


def _totals(spark: SparkSession, path: str, done: list[str]) -> DataFrame:
    return spark.read.schema("num_docs long, total long, sketch binary, load string").parquet(*[f"{path}/loads/{n}" for n in done])


def totals(spark: SparkSession, path: str) -> DataFrame:
    """One row: num_docs, total (tokens of all documents), avgdl and the merged sketch."""
    rows = _totals(spark, path, [_name(x) for x in sorted(loads(spark, path))])
    made = rows.agg(F.sum("num_docs").alias("num_docs"), F.sum("total").alias("total"), F.kll_merge_agg_bigint("sketch").alias("sketch"))
    return made.withColumn("avgdl", F.coalesce(F.try_divide("total", "num_docs"), F.lit(0.0)))


def model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(terms, stats) for BM25 over all loads; terms that no document has any more are left out."""
    rows = spark.read.schema("term string, df long, load string").parquet(*[f"{path}/terms/{_name(x)}" for x in sorted(loads(spark, path))])
    stats = totals(spark, path).select("num_docs", "avgdl")
    return R.bm25_terms(rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0"), stats), stats


def length_quantiles(spark: SparkSession, path: str, at: list[float]) -> DataFrame:
    """(q, length): about a share q of all documents counted in have so many tokens at most."""
    told = [F.struct(F.lit(float(q)).alias("q"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(q))).alias("length")) for q in at]
    return totals(spark, path).select(F.inline(F.array(*told)))
