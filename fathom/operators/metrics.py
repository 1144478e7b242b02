"""Ranking, set and attribution metrics as grouped aggregations over (query, result) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.text import ratio, same_technique, technique_set


def query_set_match(chunk: Column, source: Column, attack: Column, expected: Column, gold_sources: Column, gold_ids: Column) -> Column:
    """By id alone where ids are expected; else by source or technique."""
    wild = F.exists(gold_ids, lambda g: same_technique(attack, g))
    loose = F.coalesce(F.array_contains(gold_sources, source), F.lit(False)) | F.coalesce(wild, F.lit(False))
    return F.when(F.size(expected) > 0, F.coalesce(F.array_contains(expected, chunk), F.lit(False))).otherwise(loose)


def attribution_match(category: Column, attack: Column, pulse: Column, source: Column, content: Column, gold_ids: Column, gold_pulses: Column, gold_sources: Column, gold_actor: Column, gold_malware: Column) -> Column:
    """Relationship queries: technique and the actor's name in the text. Others: technique, else pulse, else source, this only without other gold."""
    wild = F.coalesce(F.exists(gold_ids, lambda g: same_technique(attack, g)), F.lit(False))
    named = F.coalesce(F.contains(F.lower(content), F.lower(gold_actor)), F.lit(True))
    by_pulse = F.coalesce(F.array_contains(gold_pulses, pulse), F.lit(False))
    none = (F.size(gold_ids) == 0) & (F.size(gold_pulses) == 0) & (F.coalesce(gold_malware, F.lit("")) == "")
    by_source = none & F.coalesce(F.array_contains(gold_sources, source), F.lit(False))
    return F.when(F.startswith(category, F.lit("relationship")), wild & named).otherwise(wild | by_pulse | by_source)


def per_query(results: DataFrame, queries: DataFrame, ks: list[int], n_relevant: Column | None = None) -> DataFrame:
    """(query_id, category, k, hit, rr, ndcg): ``results`` has query_id, rank (0-based) and match; ``queries`` query_id, category.

    Reciprocal ranks look at the first max(ks). The ideal gain is that of ``n_relevant`` results (a column of
    ``queries``) or, without it, of a single one, with which the value may pass 1. Queries without results count with 0."""
    deepest = max(ks)
    rows = results.where(F.col("match") & (F.col("rank") < deepest)).groupBy("query_id").agg(F.array_sort(F.collect_list("rank")).alias("at"))
    rows = queries.join(rows, "query_id", "left").withColumn("at", F.coalesce("at", F.array().cast("array<int>")))
    rows = rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    within = F.filter("at", lambda r: r < F.col("k"))
    gain = F.aggregate(within, F.lit(0.0), lambda s, r: s + 1 / F.log2((r + 2).cast("double")))
    n = F.greatest(n_relevant if n_relevant is not None else F.lit(1), F.lit(1))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(n, F.col("k")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2((i + 1).cast("double")))
    first = F.try_element_at("at", F.lit(1))
    return rows.select(
        "query_id", "category", "k", (F.size(within) > 0).cast("int").alias("hit"),
        F.coalesce(1 / (first + 1), F.lit(0.0)).alias("rr"), F.round(gain / ideal, 4).alias("ndcg"),
    )


def by_category(rows: DataFrame) -> DataFrame:
    """Means by category and k; the overall rows (category ``overall``) are means over queries, not over categories."""
    out = rows.groupingSets([["category", "k"], ["k"]], "category", "k").agg(
        F.count("*").alias("n_queries"), F.avg("hit").alias("hit_rate"), F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg"), F.grouping("category").alias("_all")
    )
    return out.withColumn("category", F.when(F.col("_all") == 1, "overall").otherwise(F.col("category"))).drop("_all")


def set_counts(rows: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    """``rows`` with tp, fp and fn of two id sets, normalised to techniques."""
    g, p = technique_set(gold), technique_set(predicted)
    return rows.withColumns({"tp": F.size(F.array_intersect(p, g)), "fp": F.size(F.array_except(p, g)), "fn": F.size(F.array_except(g, p))})


def micro(rows: DataFrame, *by: str) -> DataFrame:
    """Precision, recall and F1 of summed tp, fp and fn; 0 where a denominator is 0."""
    s = rows.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], F.count("*").alias("n"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def prefixes(results: DataFrame, label: str, ks: list[int], query: str = "query_id") -> DataFrame:
    """(query, k, labels): the first k labelled results; blanks are left out before counting."""
    named = results.where(F.coalesce(F.trim(label), F.lit("")) != "")
    place = named.withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy("rank")))
    rows = place.where(F.col("_n") <= max(ks)).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("_n") <= F.col("k"))
    return rows.groupBy(query, "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", label))), lambda x: x[label]).alias("labels"))


def recall_at(rows: DataFrame, gold: Column, found: Column, *by: str) -> DataFrame:
    """Summed found gold labels over summed gold labels."""
    counted = rows.withColumns({"_tp": F.size(F.array_intersect(found, gold)), "_g": F.size(F.array_distinct(gold))})
    return counted.groupBy(*by).agg(ratio(F.sum("_tp"), F.sum("_g")).alias("recall"))


def verdict_shares(rows: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Counts of C, P and I with the shares that are correct and plausible, as fractions and percents."""
    v = F.col(verdict)
    s = rows.agg(*[F.count_if(v == x).alias(x) for x in "CPI"], F.count("*").alias("n"))
    return s.withColumns({"correct": ratio(F.col("C"), F.col("n")), "plausible": ratio(F.col("C") + F.col("P"), F.col("n")), "correct_pct": 100 * ratio(F.col("C"), F.col("n")), "plausible_pct": 100 * ratio(F.col("C") + F.col("P"), F.col("n"))})


#: Fixed values: (category, k, least hit rate) below which an alert is raised.
ALERTS = (("overall", 10, 0.70), ("fuzzy", 10, 0.60))
F1_GATE, PLAUSIBLE_GATE = 0.65, 0.50


def alerts(metrics: DataFrame, limits: tuple = ALERTS) -> DataFrame:
    """The rows of ``by_category`` whose hit rate is under its limit, with the limit."""
    table = metrics.sparkSession.createDataFrame([(c, k, float(x)) for c, k, x in limits], "category string, k int, least double")
    return metrics.join(F.broadcast(table), ["category", "k"]).where(F.col("hit_rate") < F.col("least"))


def round_robin(rows: DataFrame, category: str, key: str, n: int) -> DataFrame:
    """n rows taken in turns from the categories in order, each by key. All rows, unchanged, where n is 0 or as many as there are."""
    if n <= 0:
        return rows
    turn = F.row_number().over(Window.partitionBy(category).orderBy(key))
    return rows.withColumn("_turn", turn).orderBy("_turn", category, key).limit(n).drop("_turn")
