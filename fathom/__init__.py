"""Retrieval, evaluation and corpus analytics as DataFrame plans."""

from __future__ import annotations

TABLE, MODEL = "points", "model"


def _pipeline(spark, table: str, model: str, config: str):
    from fathom.functions.models import hashed_vector
    from fathom.operators.retrieval import overlap_score
    from fathom.plans import ingest, retrieval

    return retrieval.build(ingest.stored_index(spark, table, model), config, embed=hashed_vector(), score=overlap_score)


def _asked(spark, text):
    return text if hasattr(text, "columns") else spark.createDataFrame([(0, text)], "query_id int, text string")


def query(text, top_k: int = 10, *, spark=None, table: str = TABLE, model: str = MODEL, config: str = "hybrid", sources=None):
    """The ``top_k`` chunks of a stored table for a text, or for each row of a DataFrame (query_id, text)."""
    from pyspark.sql import SparkSession

    spark = spark or SparkSession.active()
    return _pipeline(spark, table, model, config).run(_asked(spark, text), top_k, sources)


def answer(text, k: int = 10, *, write, prompt: str | None = None, raise_on_failure: bool = False, spark=None, **more):
    """(query_id, text, answer, cited): answers of a model ``write`` (a prompt column to an answer column) from what ``query`` finds.

    Where the model gives none the answer says so, or the run ends in an error if ``raise_on_failure``."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from fathom.functions.models import ANSWER_PROMPT, FAILED
    from fathom.plans.retrieval import answer as answered

    spark = spark or SparkSession.active()
    asked = _asked(spark, text)
    out = answered(asked, query(asked, k, spark=spark, **more), write, prompt or ANSWER_PROMPT)
    if raise_on_failure:
        out = out.where(F.when(F.col("answer") == FAILED, F.raise_error(F.lit("the model gave no answer"))).otherwise(F.lit(True)))
    return out
