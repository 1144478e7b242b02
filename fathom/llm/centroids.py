"""Centroid clustering by exponion search: exact Lloyd rounds over integer vectors that skip most distances.

Vectors have ``dims`` components and become integers, floor(SCALE * x); squared distances, sums and means are exact. Each
vector keeps its centroid and two bounds: u, at least the distance to that centroid, and l, at most the distance to any
other. A round moves the bounds by what the centroids moved; where u stays below l, or below half the distance from the
centroid to the nearest other one, nothing is computed. Else u is tightened, and where that does not help, only centroids
inside a ball around the current one are scanned: with s the distance from it to its nearest neighbour, the nearest and the
second nearest centroid of the vector lie within 2 u + s of it, so a prefix of the list of its neighbours in order of
distance suffices. The radius is inclusive, so centroids of equal distance are all seen and the least number wins.
Bounds are rounded outwards: they never decide a tie.

A round is one pass over a table in the shared folder, without a shuffle of vectors: tasks write vectors with their new
bounds, and a row for each cluster and task with the sums of its vectors, which Spark adds up; the driver gets a row for each centroid.

Defined cases: rows whose vector is null, has another number of components, or has a null or non-finite one are left out.
Integers are held to +-LIMIT, so that squared distances fit a long. Repeated rows are vectors of their own; rows without an
id stay, and of equal hashes the lesser vector comes first. Fewer vectors than centroids: as many centroids as vectors.
An empty table gives no rows. Extra columns are dropped."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm._storage import discard, kept

SCALE, LIMIT = 1024, 1 << 26
#: Distances that one step computes at once.
STEP = 1 << 20
SCHEMA = "id long, v array<int>, a int, u double, l double, n long, sums array<long>"


def vectors(df: DataFrame, key: str, column: str, dims: int) -> DataFrame:
    """(id, v) of the rows that are kept, v in integers."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(column, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x.cast("double") * SCALE))).cast("int"))
    return df.where((F.size(column) == dims) & finite).select(F.col(key).cast("long").alias("id"), whole.alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the least sha256 of seed and id."""
    order = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in rows.orderBy(order, "v").select("v").limit(k).collect()], np.int64)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows of v by rows of c)."""
    top = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * top * top * v.shape[1] < 1 << 53:  # sums of products are whole doubles
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((v - one) ** 2).sum(axis=1) for one in c], axis=1).reshape(len(v), len(c))


def above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x * (1 + 1e-14), np.inf)


def below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x * (1 - 1e-14), -np.inf)


class Search:
    """What a round knows of its centroids: their distances, each one's neighbours in order of distance, and how far they moved."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None) -> None:
        self.centroids = centroids
        between = np.sqrt(squared(centroids, centroids).astype(np.float64))
        self.order = np.argsort(between, axis=1, kind="stable").astype(np.int32)
        self.between = np.take_along_axis(between, self.order, axis=1)
        np.fill_diagonal(between, np.inf)
        self.nearest = between.min(axis=1)
        moved = np.zeros(len(centroids)) if before is None else np.sqrt(((centroids - before) ** 2).sum(axis=1).astype(np.float64))
        self.moved = above(moved)
        ranked = np.sort(self.moved)[::-1]
        # The most that any centroid but the own one moved.
        self.others = np.where(self.moved == ranked[0], ranked[min(1, len(ranked) - 1)], ranked[0])
        self.computed = 0

    def assign(self, v: np.ndarray, a: np.ndarray, u: np.ndarray, l: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each vector's nearest centroid with the bounds; ``a`` -1 where there is none yet."""
        a, new = a.copy(), a < 0
        u, l = above(u + self.moved[a]), below(l - self.others[a])
        a[new], u[new], l[new] = 0, np.inf, 0
        gate = np.maximum(l, below(self.nearest[a] / 2))
        todo = np.flatnonzero(~(u < gate))
        for at in np.array_split(todo, max(1, len(todo) * v.shape[1] // STEP)):
            near = self.centroids[a[at]]
            d = ((v[at] - near) ** 2).sum(axis=1)
            self.computed += len(at)
            u[at] = above(np.sqrt(d.astype(np.float64)))
        todo = todo[~(u[todo] < gate[todo])]
        radius = above(2 * u[todo] + self.nearest[a[todo]])
        k = len(self.centroids)
        for c in np.unique(a[todo]):
            mine = todo[a[todo] == c]
            reach = np.searchsorted(self.between[c], radius[a[todo] == c], "right")
            size = np.minimum(k, 1 << np.ceil(np.log2(np.maximum(reach, 2))).astype(np.int64))  # prefixes of a few lengths
            for m in np.unique(size):
                numbers = np.sort(self.order[c, :m])
                rows = mine[size == m]
                for at in np.array_split(rows, max(1, len(rows) * int(m) // STEP)):
                    d = squared(v[at], self.centroids[numbers])
                    self.computed += d.size
                    best = d.argmin(axis=1)  # the first, so the least number, of equals
                    each = np.arange(len(at))
                    least = d[each, best].astype(np.float64)
                    rest = np.partition(d, 1, axis=1)[:, 1].astype(np.float64) if m > 1 else np.full(len(at), np.inf)
                    a[at], u[at], l[at] = numbers[best], above(np.sqrt(least)), below(np.sqrt(rest))
        return a, u, l


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims).astype(np.int64)


def assigned(state: DataFrame, search: Search, dims: int) -> DataFrame:
    """The state's vectors with centroid and bounds, and a row for each cluster and task with the number and the sums of its vectors."""
    k, fresh = len(search.centroids), "a" not in state.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            v = _matrix(batch.column(1), dims)
            size = len(v)
            if fresh:
                a, u, l = np.full(size, -1), np.zeros(size), np.zeros(size)
            else:
                a, u, l = (batch.column(i).to_numpy() for i in (2, 3, 4))
            a, u, l = search.assign(v, a.astype(np.int64), u, l)
            n += np.bincount(a, minlength=k)
            for c in np.unique(a):
                sums[c] += v[a == c].sum(axis=0)
            empty = [pa.nulls(size, pa.int64()), pa.nulls(size, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a, pa.int32()), pa.array(u), pa.array(l), *empty], ["id", "v", "a", "u", "l", "n", "sums"])
        own = np.flatnonzero(n)
        if len(own):
            empty = [pa.nulls(len(own), t) for t in (pa.int64(), pa.list_(pa.int32()))]
            bounds = [pa.nulls(len(own), pa.float64())] * 2
            yield pa.RecordBatch.from_arrays([*empty, pa.array(own, pa.int32()), *bounds, pa.array(n[own]), pa.array(sums[own].tolist(), pa.list_(pa.int64()))], ["id", "v", "a", "u", "l", "n", "sums"])

    columns = ["id", "v"] if fresh else ["id", "v", "a", "u", "l"]
    return state.select(*columns).mapInArrow(work, SCHEMA)


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's mean vector, rounded down; those without vectors as they were."""
    total = state.where("n IS NOT NULL").groupBy("a").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(centroids.shape[1])])
    out = centroids.copy()
    for r in total.collect():
        out[r["a"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
    return out


def cluster(df: DataFrame, key: str = "vec_id", column: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, seed: str = "3:") -> DataFrame:
    """(``key``, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every kept vector, after ``rounds`` rounds and a last assignment."""
    spark = df.sparkSession
    state = kept(vectors(df, key, column, dims), "vectors", "lz4")
    centroids, before = first_centroids(state, k, seed), None
    if not len(centroids):
        return spark.createDataFrame([], f"{key} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        last, state = state, kept(assigned(state.where("v IS NOT NULL"), Search(centroids, before), dims), "round", "lz4")
        discard(last)
        before, centroids = centroids, moved(state, centroids)
    final = Search(centroids, before)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), dims)
            a, u, l = (batch.column(i).to_numpy() for i in (2, 3, 4))
            a, _, _ = final.assign(v, a.astype(np.int64), u, l)
            far = ((v - centroids[a]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int32()), pa.array(far, pa.int64())], ["id", "cluster", "distance"])

    out = kept(state.where("v IS NOT NULL").select("id", "v", "a", "u", "l").mapInArrow(work, "id long, cluster int, distance long"), "clusters")
    discard(state)
    inertia = {r["cluster"]: r["inertia"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    told = [(c, inertia.get(c), sum(inertia.values()), digest(one)) for c, one in enumerate(centroids)]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(told), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
