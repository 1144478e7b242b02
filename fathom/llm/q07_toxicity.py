"""op7: every whole text of ``documents`` scored by a model of ``labels.toxic``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import toxicity

NAME = "op7_toxicity"
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.score(documents, toxicity.train(documents, labels))
    return scored.select(
        "doc_id", (toxicity.fold_of("doc_id") == toxicity.HELD_OUT).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
