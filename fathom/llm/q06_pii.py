"""op6: personal data in every whole text of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import pii

NAME = "op6_pii"
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and ``has_pii``: whether any span was found."""
    found = pii.find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.drop("spans_list").withColumn("has_pii", F.col("spans") != "")
