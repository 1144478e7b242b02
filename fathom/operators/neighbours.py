"""Nearest neighbours by cosine: an inverted file of trained cells, searched by probes or, with its residual bounds, exactly.

How many probes reach a recall depends on the vectors; ``probes_for`` finds it on a sample of the queries.

Vectors are scaled to unit length, where the squared distance is 2 - 2 * cosine. ``build`` finds cells by Lloyd rounds over
all vectors (or a sample of a stated size), and writes every vector, with its cell and its residual, the distance to
the cell's centre, partitioned by cell. ``search`` reads the cells nearest to each query and no others. In exact mode
it then knows the distance D of each query's k-th neighbour so far, and reads what the triangle inequality leaves: cells no
farther than D plus their greatest residual, and of these the vectors whose residual differs from the centre's distance by D at most.

The centres, with a size and a greatest residual each, are what the driver and all tasks know: MOST_CELLS times the vectors'
length at most. Queries and vectors meet as a grid of blocks and parts, so neither a hot cell nor one that all queries ask for is one task."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fathom.operators import retrieval as R

MOST_CELLS = 4096
#: Vectors that one task compares with a block of queries, and queries in a block.
PART, BLOCK = 65_536, 4096
#: The cell of vectors of length zero, which have no direction; all queries read it.
ZERO = -1
#: What rounding can add to a distance; more than scores are compared to.
SLACK = 1e-6


def unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


@dataclass(frozen=True)
class CellIndex:
    """path: the vectors, as ``key``, ``vector``, residual, partitioned by cell. centres: unit vectors. sizes and radii: by cell, ZERO last."""

    spark: SparkSession
    path: str
    key: str
    vector: str
    centres: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        found = self.spark.read.parquet(f"{self.path}/cells")
        return found if cells is None else found.where(F.col("cell").isin(cells))


def _placed(vectors: DataFrame, centres: np.ndarray, key: str, vector: str) -> DataFrame:
    """(key, vector, residual, cell) of all vectors."""
    dims = centres.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = unit(matrix(batch.column(1), dims))
            near = m @ centres.T
            cell = near.argmax(axis=1)
            far = np.sqrt(np.maximum(0, 1 + (centres[cell] ** 2).sum(axis=1) - 2 * near[np.arange(len(m)), cell]))
            none = ~m.any(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.where(none, 0.0, far)), pa.array(np.where(none, ZERO, cell), pa.int32())], [key, vector, "residual", "cell"])

    kinds = f"`{key}` {vectors.schema[key].dataType.simpleString()}, `{vector}` {vectors.schema[vector].dataType.simpleString()}, residual double, cell int"
    return vectors.select(key, vector).mapInArrow(work, kinds)


def _means(vectors: DataFrame, centres: np.ndarray, vector: str) -> np.ndarray:
    """One Lloyd round: each cell's mean direction; tasks send one row for each of their cells. A cell without vectors stays where it is."""
    k, dims = centres.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, dims)), np.zeros(k, np.int64)
        for batch in batches:
            m = unit(matrix(batch.column(0), dims))
            cell = (m @ centres.T).argmax(axis=1)
            np.add.at(sums, cell, m)
            n += np.bincount(cell, minlength=k)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(sums[own].tolist(), pa.list_(pa.float64()))], ["cell", "sums"])

    parts = vectors.select(vector).mapInArrow(work, "cell int, sums array<double>")
    out = centres.copy()
    for r in parts.select("cell", F.posexplode("sums").alias("i", "x")).groupBy("cell", "i").agg(F.sum("x").alias("x")).collect():
        out[r["cell"], r["i"]] = r["x"]
    return unit(out)


def build(vectors: DataFrame, path: str, key: str = "chunk_id", vector: str = "vector", dims: int | None = None, cells: int | None = None, rounds: int = 6, sample: int | None = None) -> CellIndex:
    """Trains cells and writes the index of all vectors of ``dims`` numbers (of the first vector's length if not told) to ``path``.

    cells: the root of the number of vectors unless told. sample: train on that many vectors, those whose key has the least hash; null trains on all."""
    spark = vectors.sparkSession
    rows = vectors.select(key, vector).where(F.col(vector).isNotNull() & (F.size(vector) > 0))
    if dims is None:
        first = rows.select(F.size(vector).alias("n")).first()
        dims = first["n"] if first else 1
    rows = rows.where(F.size(vector) == dims)
    directed = rows.where(F.exists(vector, lambda x: x != 0))
    cells = min(MOST_CELLS, cells or max(1, round(directed.count() ** 0.5)))
    chance = F.xxhash64(F.col(key), F.lit(7))
    start = [r[0] for r in directed.orderBy(chance, key).select(vector).limit(cells).collect()]
    centres = unit(np.array(start, np.float64).reshape(-1, dims)) if start else np.zeros((1, dims))
    learn = directed if sample is None else directed.orderBy(chance, key).limit(sample)
    for _ in range(rounds):
        centres = _means(learn, centres, vector)
    _placed(rows, centres, key, vector).repartition("cell", F.pmod(F.xxhash64(key), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    told = spark.read.parquet(f"{path}/cells").groupBy("cell").agg(F.count("*").alias("n"), F.max("residual").alias("far")).collect() if not rows.isEmpty() else []
    sizes, radii = np.zeros(len(centres) + 1, np.int64), np.full(len(centres) + 1, -1.0)
    for r in told:
        sizes[r["cell"]], radii[r["cell"]] = r["n"], r["far"]
    model = {"key": key, "vector": vector, "centres": centres.tolist(), "sizes": sizes.tolist(), "radii": radii.tolist()}
    spark.createDataFrame([(json.dumps(model),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")
    return CellIndex(spark, path, key, vector, centres, sizes, radii)


def load(spark: SparkSession, path: str) -> CellIndex:
    m = json.loads(spark.read.text(f"{path}/model").first()[0])
    return CellIndex(spark, path, m["key"], m["vector"], np.array(m["centres"]), np.array(m["sizes"]), np.array(m["radii"]))


def met(queries: DataFrame, vectors: DataFrame, k: int, query: str, key: str) -> DataFrame:
    """(query, key, score) of the queries and vectors with the same (cell, block, part), the k best of each query in each batch, ties included.

    queries: cell, block, part, query, v, at (distance to the cell's centre), within (what residuals may differ from it).
    vectors: cell, block, part, key, v, residual. A task holds a block of queries while the vectors stream by."""
    names = [("q", query, queries), ("c", key, vectors)]
    kinds = {short: to_arrow_type(df.schema[name].dataType) for short, name, df in names}
    types = {short: df.schema[name].dataType.simpleString() for short, name, df in names}
    null = lambda t: F.lit(None).cast(t)
    double = lambda v: F.transform(v, lambda x: x.cast("double"))
    left = queries.select("cell", "block", "part", F.lit(False).alias("met"), F.col(query).alias("q"), null(types["c"]).alias("c"), double(F.col("v")).alias("v"), F.col("at").alias("x"), F.col("within").alias("y"))
    right = vectors.select("cell", "block", "part", F.lit(True).alias("met"), null(types["q"]).alias("q"), F.col(key).alias("c"), double(F.col("v")).alias("v"), F.col("residual").alias("x"), F.lit(0.0).alias("y"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, blocks, at, within, held = None, [], [], [], [], None
        for batch in batches:
            group = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            others = batch.column(3).to_numpy(zero_copy_only=False)
            x, y = batch.column(7).to_numpy(), batch.column(8).to_numpy()
            edges = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)]) if len(group) else []
            for low, high in zip(edges, [*edges[1:], len(group)], strict=True):
                if tuple(group[low]) != now:
                    now, ids, blocks, at, within, held = tuple(group[low]), [], [], [], [], None
                first = low + int(np.searchsorted(others[low:high], True))
                if first > low:
                    part = batch.column(6).slice(low, first - low)
                    ids += batch.column(4).slice(low, first - low).to_pylist()
                    blocks.append(unit(matrix(part, len(part[0]))))
                    at, within, held = [*at, *x[low:first]], [*within, *y[low:first]], None
                if first == high or not ids:
                    continue
                if held is None:
                    held = np.concatenate(blocks), np.array(at), np.array(within)
                step = max(1, R.TOGETHER // int(high - first))
                for start in range(0, len(ids), step):
                    of = slice(start, start + step)
                    near = np.abs(held[1][of, None] - x[None, first:high]) <= held[2][of, None]
                    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                    if not len(rows):
                        continue
                    part = batch.column(6).slice(first, high - first).take(pa.array(columns))
                    found = np.where(near[np.ix_(rows, columns)], held[0][of][rows] @ unit(matrix(part, held[0].shape[1])).T, -np.inf)
                    most = min(k, len(columns))
                    least = np.partition(found, len(columns) - most, axis=1)[:, len(columns) - most]
                    i, j = np.nonzero((found >= least[:, None]) & np.isfinite(found))  # ties with the last stay, to be ranked by key
                    chunk = batch.column(5).slice(first, high - first).take(pa.array(columns[j]))
                    yield pa.RecordBatch.from_arrays([pa.array([ids[start + n] for n in rows[i].tolist()], kinds["q"]), chunk, pa.array(found[i, j])], [query, key, "score"])

    order = left.unionByName(right).repartition("cell", "block", "part").sortWithinPartitions("cell", "block", "part", "met")
    return order.mapInArrow(work, f"`{query}` {types['q']}, `{key}` {types['c']}, score double")


def _nearest(index: CellIndex, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of unit vectors to the centres, infinite where a cell is empty, and each cell's place in their order."""
    far = np.sqrt(np.maximum(0, 1 + (index.centres**2).sum(axis=1) - 2 * (m @ index.centres.T)))
    far[:, index.sizes[:-1] == 0] = np.inf
    return far, far.argsort(axis=1, kind="stable").argsort(axis=1)


def probes_for(index: CellIndex, queries: DataFrame, k: int, share: float = 0.95, sample: int = 64, query: str = "query_id", vector: str = "vector") -> int:
    """The least number of probes that finds ``share`` of the k best of a sample of the queries, those whose key has the least hash.

    The sample alone is searched in full; each neighbour's cell then tells how many probes it takes to find it."""
    dims = index.centres.shape[1]
    qs = queries.select(query, F.col(vector).alias(index.vector)).where((F.size(vector) == dims) & F.exists(vector, lambda x: x != 0))
    asked = qs.orderBy(F.xxhash64(query), query).limit(sample).collect()
    if not asked or not index.sizes.any():
        return 1
    some = index.spark.createDataFrame(asked, qs.schema)
    best = R.ranked(R.dense_scores(some, index.rows(), k, query, index.key, index.vector), k, query, index.key)
    cells = index.rows().select(index.key, "cell").join(F.broadcast(best.select(query, index.key)), index.key).select(query, "cell").collect()
    at = {r[query]: i for i, r in enumerate(asked)}
    _, place = _nearest(index, unit(np.array([r[index.vector] for r in asked], np.float64)))
    places = sorted(0 if r["cell"] == ZERO else int(place[at[r[query]], r["cell"]]) for r in cells)
    return places[math.ceil(share * len(places)) - 1] + 1


def _asked(queries: DataFrame, index: CellIndex, query: str, vector: str, probes: int | None) -> DataFrame:
    """(query, v, reach, cell, at, within) of the cells that each query reads: the ``probes`` nearest, or, where that is
    null, the others that its reach, the distance of its k-th neighbour, does not rule out."""
    index, radii = replace(index, spark=None), index.radii
    dims = index.centres.shape[1]
    kinds = f"`{query}` {queries.schema[query].dataType.simpleString()}, v array<double>, cell int, at double, within double"
    zeros = bool(index.sizes[ZERO])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = unit(matrix(batch.column(1), dims))
            reach, first = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            far, place = _nearest(index, m)
            if probes is not None:
                q, c = np.nonzero((place < probes) & np.isfinite(far))
                within = np.full(len(q), np.inf)
            else:
                q, c = np.nonzero((place >= first[:, None]) & (far - radii[:-1] <= reach[:, None] + SLACK))
                within = reach[q] + SLACK
            at = far[q, c]
            if probes is not None and zeros:
                q, c, at, within = (np.r_[a, b] for a, b in ((q, np.arange(len(m))), (c, np.full(len(m), ZERO)), (at, np.zeros(len(m))), (within, np.full(len(m), np.inf))))
            lists = pa.array(m.tolist(), pa.list_(pa.float64())).take(pa.array(q))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(q)), lists, pa.array(c, pa.int32()), pa.array(at), pa.array(within)], [query, "v", "cell", "at", "within"])

    return queries.select(query, F.transform(vector, lambda x: x.cast("double")).alias("v"), "reach", F.col("probed").cast("long").alias("probed")).mapInArrow(work, kinds)


def _read(asked: DataFrame, index: CellIndex, k: int, query: str) -> DataFrame:
    """Scores of the pairs that the rows of ``asked`` name, which is a written table. Of the index only the cells asked for are read."""
    counts = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    grid = [(c, -(-n // BLOCK), int(-(-index.sizes[c] // PART))) for c, n in counts.items()]
    grid = F.broadcast(asked.sparkSession.createDataFrame(grid, "cell int, blocks int, parts int"))
    deal = lambda key, of: F.pmod(F.xxhash64(key), of).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = asked.join(grid, "cell").withColumn("block", deal(query, F.col("blocks"))).withColumn("part", each("parts"))
    rows = index.rows(sorted(counts)).join(grid, "cell").withColumn("part", deal(index.key, F.col("parts"))).withColumn("block", each("blocks"))
    return met(left, rows.withColumnRenamed(index.vector, "v"), k, query, index.key)


def search(index: CellIndex, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, query: str = "query_id", vector: str = "vector", keep=None) -> DataFrame:
    """(query, key, score): candidates among which ``ranked`` finds each query's k best of the cells probed, or of all if ``exact``.

    Queries of another length have no results. One of length zero scores 0 with all, so it is answered in full by ``dense_scores``.
    keep: writes a table and reads it back, which ends lineage; ``sinks.materialized`` unless told."""
    if keep is None:
        from fathom.sinks import materialized as keep
    spark, dims = index.spark, index.centres.shape[1]
    if not index.sizes.any():
        return spark.createDataFrame([], f"`{query}` {queries.schema[query].dataType.simpleString()}, `{index.key}` long, score double")
    qs = queries.select(query, F.col(vector).alias("v")).where(F.col("v").isNotNull() & (F.size("v") == dims))
    directed = F.exists("v", lambda x: x != 0)
    first = keep(_asked(qs.where(directed).withColumns({"reach": F.lit(0.0), "probed": F.lit(0)}), index, query, "v", probes), "probes")
    found = _read(first, index, k, query)
    if exact:
        found = keep(R.ranked(found, k, query, index.key).drop("rank"), "found")
        last = found.groupBy(query).agg(F.count("*").alias("n"), F.min("score").alias("least"))
        reach = F.when(F.col("n") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("least")))).otherwise(float("inf"))
        rest = qs.where(directed).join(last, query, "left").withColumn("reach", F.coalesce(reach, F.lit(float("inf")))).withColumn("probed", F.lit(probes))
        found = found.unionByName(_read(keep(_asked(rest, index, query, "v", None), "rest"), index, k, query))
    lost = qs.where(~directed)
    if not lost.isEmpty():
        found = found.unionByName(R.dense_scores(lost.withColumnRenamed("v", index.vector), index.rows(), k, query, index.key, index.vector))
    return found
