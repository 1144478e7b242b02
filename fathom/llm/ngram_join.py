"""N-gram Jaccard join by token-combination prefixes.

A document's set is that of its distinct K-word shingles (A-Z lower-cased; words are runs of
anything but blanks; fewer words make one shingle of them all). Two documents link where
100 * intersection >= PERCENT * union. The join finds every linked pair's component without
comparing all pairs:

1. Shingles that are frequent in the corpus are found by counting (``frequent``): class 2 from
   FREQUENT documents on, class 3 from VERY on; all others are class 1. Counts are lower bounds. Which class a shingle is in
   decides cost, never results.
2. A set of n shingles of which at most e can be missing from a partner is cut to a prefix in one
   global order: class 1 by hash, then classes 2 and 3 by bucket. Class 1 shingles are signatures of
   their own; of a bucket of class k all k-shingle combinations are. A bucket of m shingles still
   has a combination in common with a partner after m - k are missing, so the prefix is extended
   until the sum of max(0, m - k + 1) over its groups exceeds e: then any partner shares a signature
   (whichever of two prefixes ends first lies wholly within the order of the other). The number of
   buckets goes with the size level of the larger document of a pair; the smaller one signs at each
   level that it can meet.
3. Signatures are grouped, and the members of a group meet as ``meetings`` says: no link between different texts is lost.

Shingles are 64-bit hashes, signatures 48-bit ones, as a chance meeting costs no more than a look at two bitmaps. Defined cases: null and empty texts have empty sets and link with
nothing, themselves as component. Repeated rows count as copies; rows that share an id are one
document that links by any of its texts. A row without an id has its set's size and no component.
Extra columns are dropped unless asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm._storage import kept
from fathom.llm._text import column_bytes, mix, pieces, powers, shingles, word_hashes
from fathom.llm.meetings import PERCENT, WORDS, bitmap, resolve

K = 5
FREQUENT, VERY = 16, 4096
#: So many frequent shingles, the most frequent ones, are known to all tasks; the rest count as class 1.
KNOWN = 1 << 18
#: The bits of a signature.
SIGNED = np.uint64((1 << 48) - 1)
#: Documents below this size level (2 ** LEVEL shingles) sign with single shingles only.
LEVEL = 5
#: Tasks that the members of a group of frequent signatures are dealt to.
SALTS = 8
#: Bytes of text whose shingles are counted together before the shuffle.
COUNTED = 8 << 20
Known = tuple[np.ndarray, np.ndarray]


def frequent(docs: DataFrame, text: str = "text") -> Known:
    """Hashes, in order, and classes of the most frequent shingles. Every task counts all its shingles and sends those that it meets twice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            for low, high in pieces(offsets, COUNTED):
                found = []
                for a, b in pieces(offsets[low : high + 1]):
                    part = offsets[low + a : low + b + 1]
                    hashes, bounds = shingles(*word_hashes(data[part[0] : part[-1]], part - part[0]), K)
                    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                    order = np.lexsort((row, hashes))
                    h, r = hashes[order], row[order]
                    if len(h):
                        found.append(h[np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]])
                if found:
                    h, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], ["h", "n"])

    counts = docs.select(F.col(text).alias("t")).mapInArrow(work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(KNOWN).toArrow()
    h = rows["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], np.where(rows["n"].to_numpy() >= VERY, 3, 2).astype(np.int8)[order]


def classes(tokens: np.ndarray, known: Known) -> np.ndarray:
    out = np.ones(len(tokens), np.int8)
    if len(known[0]) and len(tokens):
        at = np.minimum(np.searchsorted(known[0], tokens), len(known[0]) - 1)
        hit = known[0][at] == tokens
        out[hit] = known[1][at[hit]]
    return out


def missing(n: int, percent: int = PERCENT) -> int:
    """Of a set of n, the most that a linked set can lack."""
    return n - (percent * n + 99) // 100


def _bucket_signatures(tokens: np.ndarray, k: int, level: int, need: int) -> tuple[list[np.ndarray], int]:
    """Combinations of the first buckets that give ``need``, or all; and what they give."""
    bits = level - k
    bucket = tokens >> np.uint64(64 - bits) if bits else np.zeros(len(tokens), np.uint64)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])  # tokens are in order, so buckets are too
    out, given = [], 0
    for a, b in zip(starts, np.r_[starts[1:], len(tokens)], strict=True):
        if given >= need:
            break
        m = min(b - a, need - given + k - 1)
        given += max(0, m - k + 1)
        if m >= k:
            group = tokens[a : a + m]
            picked = np.array(list(combinations(range(m), k)))
            total = np.full(len(picked), level * 4 + k, np.uint64)
            for j in range(k):
                total = mix(total + group[picked[:, j]])
            out.append(total)
    return out, given


def signatures(tokens: np.ndarray, kind: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The signatures of a set, ``tokens`` in order with their classes. The lowest bit tells those of frequent shingles, and the highest 16 are left out."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    need = missing(n, percent) + 1
    rare = tokens[kind == 1]
    parts = [rare[:need] & ~np.uint64(1)]
    if len(rare) < need:
        for level in range(n.bit_length() - 1, (100 * n // percent).bit_length()):
            left = need - len(rare)
            if level < LEVEL:
                rest = np.concatenate([tokens[kind == 2], tokens[kind == 3]])[:left]
                parts.append(mix(rest + np.uint64(level)) | np.uint64(1))
                continue
            for k in (2, 3):
                if left > 0 and (kind == k).any():
                    made, given = _bucket_signatures(tokens[kind == k], k, level, left)
                    parts += [m | np.uint64(1) for m in made]
                    left -= given
            assert left <= 0, "the buckets of a level always suffice"
    return np.unique(np.concatenate(parts) & SIGNED)


def signed(docs: DataFrame, known: Known, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, h1, h2, n, bits, sigs): a digest of the words, the set's size, its bitmap and its signatures."""

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
                sizes, sigs, bits = [], [], []
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    tokens = np.unique(hashes[a:b])
                    sizes.append(len(tokens))
                    bits.append(bitmap(tokens))
                    sigs.append(signatures(tokens, classes(tokens, known), percent).view(np.int64))
                ends = np.r_[0, np.cumsum([len(s) for s in sigs])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sigs)))
                maps = pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1, dtype=np.int32) * WORDS), pa.array(np.concatenate(bits)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *map(pa.array, digests), pa.array(sizes, pa.int32()), maps, lists], ["id", "h1", "h2", "n", "bits", "sigs"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(work, "id long, h1 long, h2 long, n int, bits array<long>, sigs array<long>")


def first_meetings(postings: DataFrame) -> DataFrame:
    """(sig, leader, id, leader_n, n) of groups of two or more, leader included; groups of frequent signatures are dealt to SALTS parts with a leader each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # sig, salt, leader, its n, whether its own row is out
        for batch in batches:
            sig, salt, ids, n = (c.to_numpy() for c in batch.columns)
            if not len(sig):
                continue
            start = np.r_[True, (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1])]
            goes_on = last is not None and (sig[0], salt[0]) == last[:2]
            if goes_on:
                start[0] = False
            run = np.cumsum(start)  # 0 for rows that go on with the last batch's run
            heads = np.flatnonzero(start)
            leader = np.r_[last[2] if goes_on else 0, ids[heads]][run]
            leader_n = np.r_[last[3] if goes_on else 0, n[heads]][run]
            size = np.bincount(run, minlength=len(heads) + 1)
            out = ~start | (size[run] > 1) | ((sig & 1) == 1)
            made = [x[out] for x in (sig, leader, ids, leader_n, n)]
            if goes_on and not last[4] and size[0]:
                made = [np.r_[x, m] for x, m in zip((last[0], last[2], last[2], last[3], last[3]), made, strict=True)]
            tail_out = bool(out[heads[-1]]) if len(heads) else True
            last = (sig[-1], salt[-1], leader[-1], leader_n[-1], tail_out)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(m, k) for m, k in zip(made, kinds, strict=True)], ["sig", "leader", "id", "leader_n", "n"])

    salt = F.when(F.col("sig").bitwiseAND(1) == 1, F.pmod("id", F.lit(SALTS))).otherwise(0).cast("int")
    order = postings.select("sig", salt.alias("salt"), "id", "n").repartition("sig", "salt").sortWithinPartitions("sig", "salt", "id")
    return order.mapInArrow(work, "sig long, leader long, id long, leader_n int, n int")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, n_shingles, component_id) for every row."""
    docs = docs.select(key, text)
    sign = kept(signed(docs, frequent(docs, text), key, text), "signed")
    return resolve(sign, docs, first_meetings, K, key, text)
