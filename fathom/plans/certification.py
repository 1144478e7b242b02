"""Certification of a model's answers against gold: per-row records, measures by part, gates, and a report that ends a job.

Technique rows are (id, platform, gold, predicted), actor rows (id, verdict: C, P or I). Of techniques only the platform of
the corpus is held to its gate; what lies outside of it is measured apart and never gated. Actors are held to the share of
plausible verdicts. A part without rows has no measures and does not pass."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators import metrics as M
from fathom.sinks import markdown

#: Fixed value: the platform that the corpus covers.
PLATFORM = "enterprise"


def records(techniques: DataFrame) -> DataFrame:
    """Technique rows with their platform in lower case, and tp, fp and fn of each."""
    rows = techniques.withColumn("platform", F.lower(F.trim(F.coalesce("platform", F.lit("")))))
    return M.set_counts(rows, F.col("gold"), F.col("predicted"))


def technique_measures(counted: DataFrame, gate: float = M.F1_GATE, platform: str = PLATFORM) -> DataFrame:
    """(platform, gated, n, tp, fp, fn, micro_f1, precision, recall, pass): a row for each platform; ``pass`` is null where there is no gate."""
    rows = M.micro(counted, "platform").withColumnRenamed("f1", "micro_f1").withColumn("gated", F.col("platform") == platform)
    return rows.select("platform", "gated", "n", "tp", "fp", "fn", "micro_f1", "precision", "recall", F.when(F.col("gated"), F.col("micro_f1") >= gate).alias("pass"))


def actor_measures(verdicts: DataFrame, gate: float = M.PLAUSIBLE_GATE) -> DataFrame:
    """(n, correct, plausible, incorrect, correct_acc, plausible_acc, pass): one row; plausible counts P alone, its share C too."""
    s = M.verdict_shares(verdicts)
    counts = [F.col(c).alias(name) for c, name in (("C", "correct"), ("P", "plausible"), ("I", "incorrect"))]
    shares = [F.col(c).alias(f"{c}_acc") for c in ("correct", "plausible")]
    return s.select("n", *counts, *shares, ((F.col("n") > 0) & (F.col("plausible") >= gate)).alias("pass"))


def certificate(techniques: DataFrame, actors: DataFrame, gates: tuple[float, float] = (M.F1_GATE, M.PLAUSIBLE_GATE)) -> dict:
    """The certificate as it is saved, for ``summary.saved`` to read: a handful of measures."""
    keep = ("n", "tp", "fp", "fn", "micro_f1", "precision", "recall")
    by = {r["platform"]: r.asDict() for r in technique_measures(records(techniques), gates[0]).collect()}
    own = by.pop(PLATFORM, None)
    actor = actor_measures(actors, gates[1]).first().asDict()
    return {
        "technique": {"enterprise": {**{k: own[k] for k in keep}, "pass": own["pass"]} if own else {"pass": False}, "mobile_out_of_corpus": {p: {k: r[k] for k in keep} for p, r in sorted(by.items())} or None},
        "actor": actor if actor["n"] else {"pass": False},
        "thresholds": {"tech_micro_f1": gates[0], "actor_plausible": gates[1]},
    }


def run(techniques: DataFrame, actors: DataFrame, out: str, gates: tuple[float, float] = (M.F1_GATE, M.PLAUSIBLE_GATE)) -> bool:
    """Writes ``out``/records (a JSON line for each technique row), ``out``/verdicts, and the certificate as ``out``/certificate.json. Whether both gates are passed."""
    from fathom.sinks import store

    spark = techniques.sparkSession
    counted = records(techniques)
    counted.write.mode("overwrite").json(f"{out}/records")
    actors.write.mode("overwrite").json(f"{out}/verdicts")
    made = certificate(techniques, actors, gates)
    store.delete(spark, f"{out}/certificate.json")
    store.put_new(spark, f"{out}/certificate.json", json.dumps(made, indent=1))
    return bool(made["technique"]["enterprise"]["pass"] and made["actor"]["pass"])


def report(techniques: DataFrame, actors: DataFrame) -> str:
    """The measures as two markdown tables."""
    return f"{markdown(technique_measures(records(techniques)).orderBy('platform'))}\n\n{markdown(actor_measures(actors))}"
