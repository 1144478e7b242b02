"""What is known of each capability, from saved results: four, side by side and never averaged.

Saved results are rows (kind, path, time, value), value being their JSON. A table names what each kind tells of which
capability and where in the JSON it stands; joined with the results it gives a row for each result and measure. A result
speaks for a capability if it has the measure that this one needs; the newest does, and of certificates of techniques one
that passed its gate before all others. Capabilities for which none speaks say so."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NONE = "NOT AVAILABLE"
NOT_RUN = "NOT RUN"
FOUND = "AVAILABLE"
SAVED = "kind string, path string, time timestamp, value string"

#: Capability, kind of result that tells of it, the measure that it needs (null: none), whether a passed gate goes first, and what is said without any.
CAPABILITIES = [
    ("technique_extraction", "certificate", "micro_f1", True, NONE),
    ("actor_attribution", "certificate", "plausible_acc", False, NONE),
    ("heterogeneous_retrieval", "attribution", "by_category", False, NONE),
    ("generation_grounding", "answers", None, False, NOT_RUN),
]
#: Where measures stand in the saved JSON: fixed values of its format. Those named ``context_`` count only with references.
PLACES = {
    "technique_extraction": {
        **{m: f"$.technique.enterprise.{m}" for m in ("n", "micro_f1", "precision", "recall", "pass")},
        "threshold": "$.thresholds.tech_micro_f1", "out_of_corpus": "$.technique.mobile_out_of_corpus",
    },
    "actor_attribution": {
        **{m: f"$.actor.{m}" for m in ("n", "correct_acc", "plausible_acc", "correct", "plausible", "incorrect", "pass")},
        "threshold": "$.thresholds.actor_plausible",
    },
    "heterogeneous_retrieval": {"query_set": "$.query_set", "by_category": "$.results[0].by_category", "set_metrics": "$.results[0].set_metrics"},
    "generation_grounding": {
        m: f"$.{m}" for m in ("status", "n", "n_failed", "n_requested", "faithfulness", "answer_relevancy", "context_precision", "context_recall", "references_available")
    },
}


def saved(spark: SparkSession, **paths: str) -> DataFrame:
    """Saved results by kind (certificate, attribution, answers), each from a path or pattern; a missing path has none."""
    out = spark.createDataFrame([], SAVED)
    for kind, path in paths.items():
        try:
            rows = spark.read.text(path, wholetext=True)
        except Exception as e:  # Spark's error for a missing path
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        out = out.unionByName(rows.select(F.lit(kind).alias("kind"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("time"), "value"))
    return out


def told(results: DataFrame) -> DataFrame:
    """(capability, path, time, measure, told): a row for each saved result and each measure that it has."""
    kinds = {c: kind for c, kind, *_ in CAPABILITIES}
    places = [(kinds[c], c, m, p) for c, own in PLACES.items() for m, p in own.items()]
    places = results.sparkSession.createDataFrame(places, "kind string, capability string, measure string, place string")
    rows = results.join(F.broadcast(places), "kind").select("capability", "path", "time", "measure", F.expr("get_json_object(value, place)").alias("told"))
    return rows.where("told IS NOT NULL")


def capabilities(results: DataFrame) -> DataFrame:
    """(capability, status, path, measures): one row for each of the four, measures by name as the result has them."""
    names = results.sparkSession.createDataFrame(CAPABILITIES, "capability string, kind string, needs string, gate_first boolean, absent string")
    measures = F.map_from_entries(F.collect_list(F.struct("measure", "told")))
    each = told(results).groupBy("capability", "path", "time").agg(measures.alias("m")).join(F.broadcast(names), "capability")
    each = each.where(F.col("needs").isNull() | F.element_at("m", F.col("needs")).isNotNull())
    first = F.col("gate_first") & F.coalesce(F.element_at("m", "pass") == "true", F.lit(False))
    best = each.groupBy("capability").agg(F.max_by(F.struct("path", "m"), F.struct(first, "time", "path")).alias("best"))
    without = F.coalesce(F.element_at("best.m", "references_available"), F.lit("false")) != "true"
    shown = F.map_filter("best.m", lambda k, v: ~(F.startswith(k, F.lit("context_")) & without) & ~k.isin("status", "references_available"))
    status = F.when(F.col("best").isNull(), F.col("absent")).otherwise(F.coalesce(F.element_at("best.m", "status"), F.lit(FOUND)))
    return names.join(best, "capability", "left").select("capability", status.alias("status"), F.col("best.path").alias("path"), shown.alias("measures"))


def report(rows: DataFrame) -> dict:
    """The four rows as JSON objects for a file: numbers, truth values and objects as the saved results have them."""

    def value(text: str):
        try:
            return json.loads(text)
        except ValueError:
            return text

    return {r["capability"]: {"status": r["status"], "source": r["path"], **{k: value(v) for k, v in sorted((r["measures"] or {}).items())}} for r in rows.collect()}
