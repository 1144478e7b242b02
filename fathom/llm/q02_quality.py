"""op2: every whole text of ``documents`` graded by a model of ``labels.quality``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import quality

NAME = "op2_quality_classifier"
#: A document is kept where the probability of the highest grade reaches this.
KEEP = 0.5
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.train(documents, labels)
    return quality.score(documents, model).withColumn("keep", F.col("p_keep") >= KEEP)
