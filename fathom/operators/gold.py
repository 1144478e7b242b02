"""Gold of relationship queries rebuilt from the graph, with where each id comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import note_actor, note_tactic, or_empty, technique_set
from fathom.operators.graph import gold_techniques, match_names

CATEGORY = "relationship_direct"
#: Fixed value: the tactic that a bundle must know.
GATE = "defense-evasion"


def has_gate(nodes: DataFrame, tactic: str = GATE) -> Column:
    """Whether any node's phases name the tactic, as an aggregate."""
    return F.coalesce(F.bool_or(F.exists("phases", lambda p: p["phase_name"] == tactic)), F.lit(False))


def all_in(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def rebuild(queries: DataFrame, sample: DataFrame, nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """``queries`` (query_id, category, notes, gold_attack_ids) with gold rebuilt for the rows of CATEGORY.

    A row gets gold_status: null for other categories, whose rows stay as they are; unresolved where its notes lack an
    actor or a tactic; actor_unmatched where no node has that name; else resolved, with gold from the graph and
    provenance. sample: query_id, gold_attack_ids of a former annotation, joined from the left. names: see ``match_names``."""
    mine = queries.where(F.col("category") == CATEGORY).withColumns({"_actor": note_actor(F.col("notes")), "_tactic": note_tactic(F.col("notes"))})
    mine = mine.join(sample.select("query_id", F.col("gold_attack_ids").alias("prev_annotator_gold")), "query_id", "left")
    matched = match_names(mine.where("_actor IS NOT NULL").select(F.col("_actor").alias("query")), names)
    mine = mine.join(matched.select(F.col("query").alias("_actor"), F.col("id").alias("_node"), "mode"), "_actor", "left")
    asked = mine.where("_node IS NOT NULL AND _tactic IS NOT NULL").select(F.col("_node").alias("actor"), F.col("_tactic").alias("tactic")).distinct()
    found = gold_techniques(asked, nodes, edges).groupBy(F.col("actor").alias("_node"), F.col("tactic").alias("_tactic")).agg(
        F.array_sort(F.collect_set("technique")).alias("_gold"), F.count_if(F.col("direct") & ~F.col("via_software")).alias("_n_direct"), F.count_if(~F.col("direct")).alias("_n_via")
    )
    mine = mine.join(found, ["_node", "_tactic"], "left")
    status = F.when(F.col("_actor").isNull() | F.col("_tactic").isNull(), "unresolved").when(F.col("_node").isNull(), "actor_unmatched").otherwise("resolved")
    gold, original = or_empty(F.col("_gold")), or_empty(F.col("gold_attack_ids"))
    told = F.struct(
        F.col("_actor").alias("actor_query"), F.col("_tactic").alias("tactic_filter"), F.col("_node").alias("actor_id"), F.col("mode").alias("actor_match_mode"),
        F.coalesce("_n_direct", F.lit(0)).alias("n_direct"), F.coalesce("_n_via", F.lit(0)).alias("n_via_software"), all_in(technique_set(original), gold).alias("seed_survived"),
    )
    resolved = F.col("gold_status") == "resolved"
    mine = mine.withColumn("gold_status", status).select(
        *[c for c in queries.columns if c != "gold_attack_ids"], F.when(resolved, gold).otherwise(F.col("gold_attack_ids")).alias("gold_attack_ids"),
        F.when(resolved, original).alias("original_gold_attack_ids"), "prev_annotator_gold",
        F.when(resolved, F.array_sort(F.array_except(technique_set(or_empty(F.col("prev_annotator_gold"))), gold))).alias("removed"), "gold_status", F.when(resolved, told).alias("gold_provenance"),
    )
    return queries.where(~F.col("category").eqNullSafe(CATEGORY)).unionByName(mine, allowMissingColumns=True)
