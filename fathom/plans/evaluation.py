"""Evaluation of retrieval and attribution against gold, as plans over all queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import same_technique
from fathom.operators import metrics as M

#: Categories with technique gold, and with pulse gold.
TECHNIQUE_CATEGORIES = ("precise", "semantic", "relationship_direct", "relationship_reverse")
PULSE_CATEGORIES = ("otx_malware",)
KS = [1, 5, 10]


def techniques(results: DataFrame, gold: DataFrame, ks: list[int] | None = None) -> DataFrame:
    """Hits and reciprocal ranks where gold is technique ids; results without an id keep their rank."""
    rows = results.join(gold.select("query_id", "gold"), "query_id").withColumn("match", F.coalesce(F.exists("gold", lambda g: same_technique(F.col("attack_id"), g)), F.lit(False)))
    return M.by_category(M.per_query(rows, gold.withColumn("category", F.lit("all")), ks or KS)).where("category = 'overall'")


def query_set(results: DataFrame, queries: DataFrame, ks: list[int] | None = None) -> DataFrame:
    """By category and overall, with the ideal gain of the expected chunks."""
    rows = results.join(queries.select("query_id", "expected_chunk_ids", "gold_sources", "gold_attack_ids"), "query_id")
    match = M.query_set_match(F.col("chunk_id"), F.col("source"), F.col("attack_id"), F.col("expected_chunk_ids"), F.col("gold_sources"), F.col("gold_attack_ids"))
    return M.by_category(M.per_query(rows.withColumn("match", match), queries, ks or KS, F.size("expected_chunk_ids")))


def attribution(results: DataFrame, queries: DataFrame, ks: list[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranking metrics, technique set metrics, pulse recall), by category."""
    ks = ks or KS
    gold = queries.select("query_id", "category", "gold_attack_ids", "gold_pulse_ids", "gold_sources", "gold_actor", "gold_malware")
    rows = results.join(gold, "query_id")
    match = M.attribution_match(*[F.col(c) for c in ("category", "attack_id", "pulse_id", "source", "content", "gold_attack_ids", "gold_pulse_ids", "gold_sources", "gold_actor", "gold_malware")])
    ranking = M.by_category(M.per_query(rows.withColumn("match", match), queries, ks))
    none = F.array().cast("array<string>")

    def at(label: str, categories: tuple[str, ...]) -> DataFrame:
        base = queries.where(F.col("category").isin(*categories)).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
        return base.join(M.prefixes(results, label, ks), ["query_id", "k"], "left").withColumn("labels", F.coalesce("labels", none))

    sets = M.micro(M.set_counts(at("attack_id", TECHNIQUE_CATEGORIES), F.col("gold_attack_ids"), F.col("labels")), "category", "k")
    recall = M.recall_at(at("pulse_id", PULSE_CATEGORIES), F.col("gold_pulse_ids"), F.array_distinct("labels"), "category", "k")
    return ranking, sets, recall


def certify(predictions: DataFrame, verdicts: DataFrame) -> dict[str, bool]:
    """Whether technique micro-F1 (on rows gold, predicted) and plausible attributions (verdict) reach their gates."""
    f1 = M.micro(M.set_counts(predictions, F.col("gold"), F.col("predicted"))).first()["f1"]
    share = M.verdict_shares(verdicts).first()["plausible"]
    return {"techniques": f1 >= M.F1_GATE, "actors": share >= M.PLAUSIBLE_GATE}


def judge_means(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Means of an external judge's scores over rows that have them, to 4 places; -1 where none has."""
    return rows.agg(*[F.coalesce(F.round(F.avg(c), 4), F.lit(-1.0)).alias(c) for c in columns])
