"""op5: repeats of 400 bytes removed from the whole texts of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import suffix_dedup

NAME = "op5_suffix_dedup"
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and ``has_repeat``: whether any byte is removed."""
    found = suffix_dedup.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_kept=False)
    return found.withColumn("has_repeat", F.col("n_removed") > 0)
