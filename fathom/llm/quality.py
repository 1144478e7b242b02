"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight for each hashed text feature is shared by all grades, and ordered thresholds cut the
score: P(grade <= g) = sigmoid(threshold_g - score). A document's features are the shares of its
hashed shape runs (what kinds of characters follow one another within FEATURE_SPANS bytes) and word
lengths, so that a document of any length has features of one scale. The results are the expected
grade and the probability of at least a wanted grade, by which documents are selected.

Fitting takes at most SAMPLE labelled rows, those with the least hash of their id, the same however
the table is laid out; that bound is the only one. Every document is scored over its whole text.

Defined cases: null and empty texts have no features and get the score of the bias alone. Labels
that are null or of documents that do not exist are ignored; of several labels of one document the
least is taken. With no label or a single grade the grade is the known one (or 0) for all. Repeated
rows are scored alike and all kept. Extra columns are dropped unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm._text import column_bytes, find_words, mix, pieces

#: Labelled rows that are fitted on.
SAMPLE = 6000
BITS = 16
#: Bytes of the runs whose shapes are features.
FEATURE_SPANS = (2, 4)
#: The kinds of bytes: lower, upper, digit, space, line end, letters beyond ASCII; each sign is one of its own.
KIND = np.zeros(256, np.uint64)
KIND[:] = np.arange(256)
KIND[97:123], KIND[65:91], KIND[48:58] = 97, 65, 48
KIND[128:] = 97
KIND[[9, 11, 12, 13]] = 32
SCORES = "expected_grade double, p_keep double"


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, buckets, values): each row's values sum to 1 for each kind of feature."""
    n = len(offsets) - 1
    rows, buckets, values = [], [], []
    kind = KIND[data]
    row_of = np.repeat(np.arange(n), np.diff(offsets))

    def add(row: np.ndarray, code: np.ndarray, salt: int) -> None:
        bucket = (mix(code + np.uint64(salt << 56)) >> np.uint64(64 - BITS)).astype(np.int64)
        both, count = np.unique(row * (1 << BITS) + bucket, return_counts=True)
        rows.append(both >> BITS)
        buckets.append(both & ((1 << BITS) - 1))
        values.append(count / np.maximum(1, np.bincount(row, minlength=n))[rows[-1]])

    for size in FEATURE_SPANS:
        if len(data) >= size:
            code = np.zeros(len(data) - size + 1, np.uint64)
            for j in range(size):
                code = code * np.uint64(257) + kind[j : len(data) - size + 1 + j]
            whole = row_of[: len(code)] == row_of[size - 1 :]
            add(row_of[: len(code)][whole], code[whole], size)
    starts, ends, first = find_words(data, offsets)
    if len(starts):
        add(np.repeat(np.arange(n), np.diff(first)), np.minimum(ends - starts, 40).astype(np.uint64), 9)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(buckets), np.concatenate(values)


@dataclass
class Model:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def cumulative(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= g) for all but the last grade, a row for each score."""
        return sigmoid(self.thresholds[None, :] - score[:, None])

    def expected(self, score: np.ndarray) -> np.ndarray:
        below = np.c_[np.zeros(len(score)), self.cumulative(score), np.ones(len(score))]
        return np.diff(below, axis=1) @ np.array(self.grades, float)

    def at_least(self, score: np.ndarray, grade: int) -> np.ndarray:
        """P(grade >= ``grade``)."""
        lower = sum(g < grade for g in self.grades)
        if lower == 0:
            return np.ones(len(score))
        if lower == len(self.grades):
            return np.zeros(len(score))
        return 1 - self.cumulative(score)[:, lower - 1]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, buckets, values = features(data, offsets)
        return np.bincount(rows, self.weights[buckets] * values, minlength=len(offsets) - 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(rows: list[tuple[list[int], list[float], int]], rounds: int = 300, rate: float = 0.5, decay: float = 1e-6) -> Model:
    """Full-batch Adam on the cumulative-link likelihood; thresholds are kept ordered by fitting the logs of their gaps."""
    grades = sorted({g for _, _, g in rows})
    if len(grades) < 2:
        return Model(grades or [0], np.zeros(1 << BITS), np.zeros(0))
    at = {g: i for i, g in enumerate(grades)}
    y = np.array([at[g] for _, _, g in rows])
    used, column = np.unique(np.concatenate([np.asarray(b, np.int64) for b, _, _ in rows]), return_inverse=True)
    value = np.concatenate([np.asarray(v, float) for _, v, _ in rows])
    row = np.repeat(np.arange(len(rows)), [len(b) for b, _, _ in rows])
    scale = np.sqrt(np.bincount(column, value**2) / len(rows)) + 1e-3
    value = value / scale[column]
    k = len(grades) - 1
    share = np.clip(np.cumsum(np.bincount(y, minlength=k + 1)) / len(y), 1e-3, 1 - 1e-3)[:-1]
    start = np.log(share / (1 - share))
    params = np.concatenate([np.zeros(len(used)), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    nw = len(used)
    step = rate * np.r_[np.full(nw, 0.1), np.full(k, 0.2)]
    for t in range(1, rounds + 1):
        score = np.bincount(row, params[column] * value, minlength=len(rows))
        cuts = np.cumsum(np.r_[params[nw], np.exp(params[nw + 1 :])])
        edge = np.r_[-np.inf, cuts, np.inf]
        high, low = sigmoid(edge[y + 1] - score), sigmoid(edge[y] - score)
        p = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high) / p, low * (1 - low) / p
        slope = dh - dl  # of the loss in the score
        g_cut = np.bincount(y, -dh, minlength=k + 1)[:k] + np.bincount(np.maximum(y - 1, 0), np.where(y > 0, dl, 0), minlength=k + 1)[:k]
        tail = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate([np.bincount(column, slope[row] * value, minlength=nw) / len(rows) + decay * params[:nw], [tail[0] / len(rows)], tail[1:] * np.exp(params[nw + 1 :]) / len(rows)])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(1 << BITS)
    weights[used] = params[:nw] / scale
    return Model(grades, weights, np.cumsum(np.r_[params[nw], np.exp(params[nw + 1 :])]))


def sampled(labels: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """At most ``most`` labelled keys, those with the least hash: a bounded table, with one label for each key."""
    one = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(label).cast("int").alias("_label"))
    return one.orderBy(F.xxhash64(F.col("_key").cast("string")), "_key").limit(most)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = SAMPLE) -> Model:
    """Features come from the executors; the driver gets those of ``most`` documents at most."""
    few = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(sampled(labels, key, label, most)), "_key").select("_text", "_label")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            for low, high in pieces(offsets):
                rows, buckets, values = features(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                order = np.argsort(rows, kind="stable")
                ends = np.r_[0, np.cumsum(np.bincount(rows, minlength=high - low))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(buckets[order].astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(values[order].astype(np.float32))),
                    batch.column(1).slice(low, high - low),
                ], ["b", "v", "g"])

    rows = few.mapInArrow(work, "b array<int>, v array<float>, g int").toArrow()
    return fit(sorted(zip(rows["b"].to_pylist(), rows["v"].to_pylist(), rows["g"].to_pylist(), strict=True)))


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), grade: int | None = None) -> DataFrame:
    """Columns ``keep`` with expected_grade and p_keep, the probability of ``grade`` (the highest, if not given) or more."""
    grade = max(model.grades) if grade is None else grade
    kept = df_schema(docs, keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            found = np.zeros(batch.num_rows)
            for low, high in pieces(offsets):
                found[low:high] = model.score(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            made = [pa.array(model.expected(found)), pa.array(model.at_least(found, grade))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], [*keep, "expected_grade", "p_keep"])

    return docs.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(work, f"{kept}, {SCORES}")


def df_schema(df: DataFrame, columns: tuple[str, ...]) -> str:
    """The DDL of some columns."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
