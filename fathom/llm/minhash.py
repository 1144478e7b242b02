"""Near-duplicate documents by one-permutation MinHash with optimal densification.

A document's set is that of its distinct K-word shingles (A-Z lower-cased; words are runs of anything but blanks; fewer
words make one shingle of them all). Two documents link where 100 * intersection >= PERCENT * union.

1. One hash of each shingle deals it to one of BANDS * ROWS bins; a bin keeps its least hash (one permutation serves all
   bins). An empty bin takes the value of another, found by a sequence of bins that depends on the empty bin alone and is
   the same for all documents (optimal densification): so each bin still agrees with the probability of the two sets'
   similarity, and bins fail independently, also in sets of few shingles.
2. ROWS bins make a band, whose hash is a signature. Two documents of similarity s share none with probability
   (1 - s ** ROWS) ** BANDS: 1e-11 at 0.8, and 2e-17 at 0.85.
3. In each bucket of a signature the candidate edges are a star: the least document meets the others, a large bucket in
   several parts. Every edge is confirmed on full sets. Buckets whose members are not one component by then go on in
   rounds (``meetings``), so links between members that the star's centre links with neither of are found too.

Defined cases: null and empty texts have empty sets and link with nothing, themselves as component. Repeated rows count as
copies; rows that share an id are one document that links by any of its texts. A row without an id has its set's size and
no component. Extra columns are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm._storage import kept
from fathom.llm._text import column_bytes, mix, pieces, powers, shingles, word_hashes
from fathom.llm.meetings import WORDS, bitmap, resolve

K, BANDS, ROWS = 2, 48, 4
EMPTY = np.uint64(2**64 - 1)


def probe(bins: np.ndarray, attempt: int, of: int) -> np.ndarray:
    """The bin that each empty bin tries at this attempt."""
    return (mix(bins.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(of)).astype(np.int64)


def densified(least: np.ndarray) -> np.ndarray:
    """``least`` (sets by bins, EMPTY where a bin has nothing) with each empty bin filled from the first bin of its sequence
    that has a value of its own. Sets without any shingle stay empty."""
    out, filled = least.copy(), least != EMPTY
    row, bin_ = np.nonzero(~filled & filled.any(axis=1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        source = probe(bin_, attempt, least.shape[1])
        hit = filled[row, source]
        out[row[hit], bin_[hit]] = least[row[hit], source[hit]]
        row, bin_ = row[~hit], bin_[~hit]
    return out


def bins_of(tokens: np.ndarray, row: np.ndarray, n: int, bins: int) -> np.ndarray:
    """The least hash in each bin for each of ``n`` sets; token i belongs to set row[i], repeats do no harm."""
    out = np.full(n * bins, EMPTY)
    np.minimum.at(out, row * bins + (tokens % np.uint64(bins)).astype(np.int64), mix(tokens) >> np.uint64(1))
    return out.reshape(n, bins)


def band_signatures(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(sets by bands) a hash of each band's bins."""
    groups = values.reshape(len(values), bands, -1)
    total = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), groups.shape[:2]).copy()
    for j in range(groups.shape[2]):
        total = mix(total + groups[:, :, j])
    return total


def signed(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, h1, h2, n, bits, sigs): a digest of the words, the set's size, its bitmap and its bands' signatures."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for low, high in pieces(offsets):
                words, first = word_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                hashes, bounds = shingles(words, first, K)
                up, down = powers(len(words) + 1)
                digests = []
                for salt in (1, 2):
                    sums = np.zeros(len(words) + 1, np.uint64)
                    np.cumsum(mix(words + np.uint64(salt)) * up[: len(words)], out=sums[1:])
                    digests.append(mix((sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64))
                sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                sizes = np.array([len(s) for s in sets])
                maps = np.concatenate([bitmap(s) for s in sets])
                own = np.repeat(np.arange(high - low), np.diff(bounds))
                values = band_signatures(densified(bins_of(hashes, own, high - low, bands * rows)), bands)[sizes > 0]
                ends = np.r_[0, np.cumsum(np.where(sizes > 0, bands, 0))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1).view(np.int64)))
                bits = pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1, dtype=np.int32) * WORDS), pa.array(maps))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *map(pa.array, digests), pa.array(sizes, pa.int32()), bits, lists], ["id", "h1", "h2", "n", "bits", "sigs"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(work, "id long, h1 long, h2 long, n int, bits array<long>, sigs array<long>")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, n_shingles, component_id, kept) for every row; kept tells the document of a component that stands for it."""
    docs = docs.select(key, text)
    found = resolve(kept(signed(docs, key, text), "signed", "lz4"), docs, k=K, key=key, text=text)
    return found.withColumn("kept", F.col(key) == F.col("component_id"))
