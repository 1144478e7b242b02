"""op3: every whole text of ``documents`` encoded by public ranks and decoded again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fathom.llm.bpe import encode

NAME = "op3_byte_bpe"
RANKS = "byte_bpe_multi_50k.tiktoken"
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(documents, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_ids=False)
