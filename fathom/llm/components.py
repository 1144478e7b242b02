"""Connected components of a table of links, by alternating star contraction.

Every round points each node's larger neighbours, then its smaller ones, at the least node it sees;
both steps are a grouped minimum (combined before the shuffle) and a join back, so a node of very
many links is never gathered anywhere. The links shrink to one (node, least of its component) row
for each node but the least. Rounds are tables in the shared folder; their number grows with the
logarithm of the links' longest path. As soon as no more than BASE links are left, which is checked,
one task ends the work by union-find instead of further rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm._storage import discard, kept

#: Links (16 bytes each) that one task joins.
BASE = 1_000_000


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (u, v), each once with u > v. Large: all neighbours greater than the node; small: the node and its lesser ones."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        out = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root.setdefault(up, up)
            x = root[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(u), top(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    rows = [(x, top(x)) for x in list(root)]
    for low in range(0, len(rows), 100_000):
        part = rows[low : low + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([y for _, y in part], pa.int64())], ["id", "component"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the least id reachable, for every id with a link; null ids and links to itself are left out."""
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    rows = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = kept(rows.select(high.alias("u"), low.alias("v")).distinct(), "links")
    before = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen[0] <= BASE:
            out = kept(now.coalesce(1).mapInArrow(_joined, "id long, component long"), "components")
            discard(now)
            return out
        if tuple(seen) == before:
            roots = now.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
        before, last = tuple(seen), now
        now = kept(_star(_star(now, True), False), "links")
        discard(last)
