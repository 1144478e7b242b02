"""Toxicity: a factorization machine over hashed terms.

A document's terms are its words, with A-Z lower-cased and signs as gaps, and the beginnings of the
longer ones, by which compound and inflected words share a term, all hashed; those that it holds are
its features, each with value 1. Besides a weight, every term has a vector, and the
product of two terms' vectors is the weight of their occurring together: an insult beside a group's
name weighs more than both alone. Those terms have parameters that the sample holds evidence for: all whose
likelihood-ratio statistic on the label reaches EVIDENCE, however many, and LEAST at the least; the others count as zero.

Fitting takes at most SAMPLE labelled rows, those with the least hash of their id. Labels whose
crc32(id as text) mod FOLDS is HELD_OUT are never fitted on. Every document is scored over its whole text.

Defined cases: null and empty texts have no terms and get the bias. Null labels and labels of
missing documents are ignored; of several labels of one document the least is taken. Without labels
of both kinds every score is the share of the known kind (0.5 without any). Repeated rows are scored
alike and all kept; extra columns are dropped unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm._text import LOWER, column_bytes, find_words, pieces, prefix_hash, span_hash
from fathom.llm.quality import df_schema, sampled, sigmoid

SAMPLE = 8000
#: The statistic (chi-squared, one degree of freedom) from which a term counts as told by the label; chance passes one in 25 million.
EVIDENCE = 30.0
#: So many terms have parameters even without evidence of their own: two can tell together what neither does.
LEAST = 512
FACTORS = 4
BITS = 22
#: Bytes of the beginnings that are terms too.
BEGINNINGS = (4, 5, 6, 7)
FOLDS, HELD_OUT = 5, 0
#: Bytes of words; all others are taken off a word's ends. Bytes beyond ASCII count as letters.
INNER = np.zeros(256, bool)
INNER[48:58] = INNER[97:123] = INNER[65:91] = True
INNER[128:] = True


def fold_of(key: str) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, hashes) of all terms, repeats included: maximal runs of letters and digits, and the longer ones' beginnings."""
    low = np.where(INNER[data], LOWER[data], 32).astype(np.uint8)
    starts, ends, first = find_words(low, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if not len(starts):
        return row, np.zeros(0, np.int64)
    sums, size = prefix_hash(low), ends - starts
    rows, codes = [row], [span_hash(sums, starts, ends)]
    for n in BEGINNINGS:
        longer = size > n
        at = starts[longer]
        rows.append(row[longer])
        codes.append(~span_hash(sums, at, at + n))
    return np.concatenate(rows), (np.concatenate(codes) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    #: Term hashes in order, and their parameters.
    known: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        held = getattr(self, "_table", None)
        if held is None:
            held = np.full(1 << BITS, -1, np.int32)
            held[self.known] = np.arange(len(self.known))
            self._table = held
        row, code = terms(data, offsets)
        at = held[code]
        both = np.unique((row[at >= 0] << BITS) | at[at >= 0])
        return sigmoid(predict(both >> BITS, both & ((1 << BITS) - 1), n, self.bias, self.weights, self.vectors))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_table"}


def predict(row: np.ndarray, term: np.ndarray, n: int, bias: float, weights: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Bias, weights, and half of (the squared sum of the vectors less the sum of their squares)."""
    out = bias + np.bincount(row, weights[term], minlength=n)
    for f in range(vectors.shape[1]):
        v = vectors[term, f]
        out += 0.5 * (np.bincount(row, v, minlength=n) ** 2 - np.bincount(row, v * v, minlength=n))
    return out


def informative(row: np.ndarray, code: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The codes, in order, whose likelihood-ratio statistic on the label (twice the rows times their mutual information) reaches
    EVIDENCE, and LEAST of the greatest; of equals the lesser codes."""
    count = np.bincount(code)
    codes = np.flatnonzero(count)
    n, n1 = len(y), y.sum()
    here = count[codes].astype(float)
    both = np.bincount(code, y[row])[codes]
    info = np.zeros(len(codes))
    for a, pa_, pb in ((both, here, n1), (here - both, here, n - n1), (n1 - both, n - here, n1), (n - n1 - here + both, n - here, n - n1)):
        with np.errstate(divide="ignore", invalid="ignore"):
            info += np.where(a > 0, a / n * np.log(a * n / (pa_ * pb)), 0)
    told = 2 * n * info >= EVIDENCE
    told[np.lexsort((codes, -info))[:LEAST]] = True
    return codes[told & (info > 0)]


def fit(docs: list[np.ndarray] | list[list[int]], labels: list[int], rounds: int = 400, rate: float = 0.05, decay: float = 2e-4, seed: int = 7) -> Model:
    """Full-batch Adam on the logistic loss; positive rows weigh as much as negative ones in part."""
    y = np.array(labels, float)
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(0, np.int64), float(np.log((share + 1e-3) / (1 - share + 1e-3))), np.zeros(0), np.zeros((0, FACTORS)))
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    code = np.concatenate([np.asarray(d, np.int64) for d in docs])
    known = informative(row, code, y)
    at = np.searchsorted(known, code)
    hit = at < len(known)
    hit[hit] = known[at[hit]] == code[hit]
    row, term = row[hit], at[hit]
    n, k = len(docs), len(known)
    share = y.mean()
    bias = float(np.log(share / (1 - share)))
    w, v = np.zeros(k), np.random.default_rng(seed).normal(0, 0.05, (k, FACTORS))
    state = [np.zeros(k), np.zeros(k), np.zeros_like(v), np.zeros_like(v), 0.0, 0.0]
    for t in range(1, rounds + 1):
        slope = (sigmoid(predict(row, term, n, bias, w, v)) - y) / n
        gw = np.bincount(term, slope[row], minlength=k) + decay * w
        gv = np.empty_like(v)
        for f in range(FACTORS):
            total = np.bincount(row, v[term, f], minlength=n)
            gv[:, f] = np.bincount(term, slope[row] * (total[row] - v[term, f]), minlength=k) + decay * v[:, f]
        gb = slope.sum()
        fix1, fix2 = 1 - 0.9**t, 1 - 0.99**t
        for i, g in ((0, gw), (2, gv), (4, gb)):
            state[i] = 0.9 * state[i] + 0.1 * g
            state[i + 1] = 0.99 * state[i + 1] + 0.01 * g * g
        move = [rate * (state[i] / fix1) / (np.sqrt(state[i + 1] / fix2) + 1e-7) for i in (0, 2, 4)]
        w, v, bias = w - move[0], v - move[1], bias - float(move[2])
    return Model(known, bias, w, v)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE) -> Model:
    """The executors send each sampled document's distinct terms; the driver gets those of ``most`` documents at most."""
    usable = labels.where(fold_of(key) != HELD_OUT)
    few = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(sampled(usable, key, label, most)), "_key").select("_text", "_label")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            for low, high in pieces(offsets):
                row, code = terms(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                both = np.unique((row << BITS) | code)
                ends = np.r_[0, np.cumsum(np.bincount(both >> BITS, minlength=high - low))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((both & ((1 << BITS) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([lists, batch.column(1).slice(low, high - low)], ["t", "y"])

    rows = few.mapInArrow(work, "t array<int>, y int").toArrow()
    labelled = rows["y"].to_pylist()
    held = [c for c in rows["t"].chunks if len(c)]
    found = [np.asarray(c.values)[low:high] for c in held for low, high in pairwise(c.offsets.to_pylist())]
    # In the order of the terms, so that sums do not depend on the order in which rows arrive.
    order = sorted(range(len(found)), key=lambda i: (found[i].astype(">i4").tobytes(), labelled[i]))
    return fit([found[i] for i in order], [int(labelled[i] > 0) for i in order])


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``score``, the probability of label 1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            found = np.zeros(batch.num_rows)
            for low, high in pieces(offsets):
                found[low:high] = model.score(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found)], [*keep, "score"])

    return docs.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(work, f"{df_schema(docs, keep)}, score double")
