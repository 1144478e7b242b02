"""Keyed operators: first and last by key, latest snapshots, pending work, positional joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_by_key(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key; a grouped maximum of structs, so rows combine before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    at = F.struct(*[F.col(c) for c in order])
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), at).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def first_by_key(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*[F.col(c) for c in order])).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their keys; of several new rows the last by ``seq`` counts. Without that column a key has one new row, or rows that are equal."""
    fresh = last_by_key(new, keys, "seq").drop("seq") if "seq" in new.columns else new.dropDuplicates(keys)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh.select(*old.columns))


def pending(all_: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return all_.join(done.select(key).distinct(), key, "left_anti")


def zipped(left: DataFrame, right: DataFrame, position: str = "position") -> DataFrame:
    """A join by line number; tables of different lengths are an error that shows when the result is used."""
    both = left.join(right, position, "full_outer")
    lacks = F.lit(False)
    for df in (left, right):
        marks = [c for c in df.columns if c != position]
        lacks = lacks | F.coalesce(*[F.col(c).cast("string") for c in marks]).isNull()
    return both.where(F.when(lacks, F.raise_error(F.lit("tables of different lengths"))).otherwise(F.lit(True)))


def newest(rows: DataFrame, time: Column) -> DataFrame:
    return rows.orderBy(time.desc()).limit(1)


def running_groups(rows: DataFrame, by: str, order: str, starts: Column) -> DataFrame:
    """``rows`` with ``group``: how many starts were seen up to each row."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("group", F.sum(starts.cast("int")).over(w))
