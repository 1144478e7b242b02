"""A corpus pipeline: documents are graded, near copies and test items go, personal data is masked, the rest is encoded.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result as
Parquet in the shared folder and reads it again for the next stage. All but the last stage return
the columns of ``documents``, extra ones included, whatever their names. Nulls, empty texts and repeated rows are treated
as the operators' docstrings say; of rows that the join stage finds to be one document, with all columns equal, one stays."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import bpe, decontaminate, ngram_join, pii, quality
from fathom.llm._storage import discard, kept, renamed
from fathom.llm.q02_quality import KEEP
from fathom.llm.q03_bpe import RANKS

#: The classifier and the chain model have no SQL form.
ORACLE_SQL = None


def graded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. It is fitted on all labelled documents it is given, up to its sample's bound."""
    inner, back = renamed(docs, ("doc_id", "text"))
    model = quality.train(inner, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return back(quality.score(inner, model, keep=tuple(inner.columns)).where(F.col("p_keep") >= KEEP))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id; rows without an id and empty documents all stay.

    Rows that are equal in all columns are one; only those whose id is there more than once are compared, by a digest."""
    inner, back = renamed(docs, ("doc_id", "text"))
    found = ngram_join.join(inner).where(F.col("component_id") == F.col("doc_id")).select("doc_id").distinct()
    several = kept(inner.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id"), "several")
    first = inner.where("doc_id IS NOT NULL").join(found, "doc_id", "left_semi")
    again = first.join(several, "doc_id", "left_semi").select("doc_id", F.struct(*inner.columns).alias("_row"))
    again = again.groupBy("doc_id", F.sha2(F.to_json("_row"), 256)).agg(F.any_value("_row").alias("_row")).select("_row.*")
    kept_rows = first.join(several, "doc_id", "left_anti").unionByName(again)
    return back(kept_rows.unionByName(inner.where("doc_id IS NULL")))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data masked; n_chars follows the text."""
    inner, back = renamed(docs, ("text", "n_chars"))
    out = pii.redact(inner)
    if "n_chars" in inner.columns:
        out = out.withColumn("n_chars", F.length("text").cast(inner.schema["n_chars"].dataType))
    return back(out)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the ids of its text, their number, and the digests of the ids and of their decoding."""
    return bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("quality", graded), ("ngram_jaccard", one_of_each), ("decontaminate", decontaminated), ("pii", masked), ("byte_bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        last, docs = docs, kept(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(last)
    return docs
