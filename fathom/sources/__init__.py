"""Sources: feeds, bundles, reports and pages to canonical documents.

A document has id, source, content, metadata (a JSON string), attack_id, pulse_id and retrieved_at.
Every source splits its rows into good ones and skipped ones by a predicate and counts the latter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fathom.functions.text import clean, document_id

DOCUMENT = ("id", "source", "content", "metadata", "attack_id", "pulse_id", "retrieved_at")


def documents(rows: DataFrame, source: str, prefix: str, key: Column, content: Column, metadata: dict[str, Column], attack_id: Column | None = None, pulse_id: Column | None = None, valid: Column | None = None, watch: Observation | None = None) -> DataFrame:
    """Rows to documents. Rows that are not valid, lack a key or have blank content are skipped; ``watch`` counts documents and skipped rows."""
    text = clean(content)
    ok = F.coalesce((valid if valid is not None else F.lit(True)) & key.isNotNull() & text.isNotNull(), F.lit(False))
    if watch is not None:
        rows = rows.withColumn("_ok", ok).observe(watch, F.count_if("_ok").alias("documents"), F.count_if(~F.col("_ok")).alias("skipped"))
        ok = F.col("_ok")
    none = F.lit(None).cast("string")
    return rows.where(ok).select(
        document_id(prefix, key).alias("id"), F.lit(source).alias("source"), text.alias("content"),
        F.to_json(F.struct(*[c.alias(n) for n, c in metadata.items()])).alias("metadata"),
        (attack_id if attack_id is not None else none).alias("attack_id"), (pulse_id if pulse_id is not None else none).alias("pulse_id"),
        F.localtimestamp().alias("retrieved_at"),
    )
