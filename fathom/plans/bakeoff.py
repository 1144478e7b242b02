"""Embedding models compared on one corpus: exact search for the chunk that each query was made from."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions.models import Embedder
from fathom.operators import retrieval as R
from fathom.sinks import materialized


@dataclass(frozen=True)
class Score:
    name: str
    recall_at_k: float
    mrr: float
    corpus_seconds: float
    query_seconds: float


def evaluate(found: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """One row: recall_at_k and mrr, over all queries of ``gold`` (query_id, gold); found: query_id, chunk_id, rank."""
    hits = found.where(F.col("rank") < k).join(gold, "query_id").where(F.col("chunk_id") == F.col("gold")).groupBy("query_id").agg(F.min("rank").alias("at"))
    rows = gold.join(hits, "query_id", "left")
    return rows.agg(F.avg(F.col("at").isNotNull().cast("int")).alias("recall_at_k"), F.avg(F.coalesce(1 / (F.col("at") + 1), F.lit(0.0))).alias("mrr"))


def best_first(scores: DataFrame, by: tuple[str, ...] = ("recall_at_k", "mrr")) -> DataFrame:
    """Models by recall, then mean reciprocal rank; a report orders by ``("mrr", "recall_at_k")``."""
    return scores.orderBy(*[F.desc(c) for c in by], "name")


def run(corpus: DataFrame, queries: DataFrame, gold: DataFrame, models: dict[str, Embedder], k: int = 10) -> DataFrame:
    """A row for each model (Score), best first. Vectors are written tables, so that times are those of encoding."""
    rows = []
    for name, embed in models.items():
        took = [time.perf_counter()]
        vectors = materialized(corpus.select("chunk_id", embed(F.col("content")).alias("vector")), "corpus-vectors")
        took.append(time.perf_counter())
        asked = materialized(queries.select("query_id", embed(F.col("text")).alias("vector")), "query-vectors")
        took.append(time.perf_counter())
        got = evaluate(R.ranked(R.dense_scores(asked, vectors, k), k), gold, k).first()
        rows.append(asdict(Score(name, float(got["recall_at_k"] or 0), float(got["mrr"] or 0), round(took[1] - took[0], 3), round(took[2] - took[1], 3))))
    return best_first(corpus.sparkSession.createDataFrame(rows, "name string, recall_at_k double, mrr double, corpus_seconds double, query_seconds double"))
