"""op4: every whole text of ``documents`` searched for the items of ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import decontaminate

NAME = "op4_decontaminate"
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate.matched(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", (F.size("matches") > 0).alias("contaminated"), F.size("matches").cast("long").alias("n_items"),
        F.col("matches.item_id").alias("item_ids"), F.array_min("matches.distance").alias("least_distance"),
    )
