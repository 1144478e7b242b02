"""Suffix-array dedup: removal of every byte covered by a SPAN-byte string that starts elsewhere too.

A full suffix array of a corpus is not needed to find repeats of SPAN bytes: each window of SPAN
bytes names one of its GRAM-byte grams, the one of least hash, so two equal windows name the same
gram at the same place. The places named are anchors; only anchors whose gram occurs at two or more
have anything to compare. For each of these, the suffix from the anchor on and the bytes before it
(reversed) are ordered among the others of its gram by deep-shallow sorting (``suffix_sort``), cut to
what the windows around the anchor reach. Joining neighbours from the longest common prefix down,
smaller side into larger, every anchor meets the partner that shares most to the left for each
length shared to the right; where both together reach SPAN, that stretch is a repeat. All repeats at
an anchor contain it, so their union is one stretch.

Equal texts are found by their digests first: one of them stands for all in the search, and all are
removed whole. A gram of more than HOT anchors is dealt to several groups: partners of SPAN bytes
share at least half of these on one side, so anchors meet by the next half SPAN to the right and by
the last to the left. The join that finds repeated grams deals such a gram's anchors too. Grams that repeat themselves with a short period are named last, so a run of
one word over and over has few anchors.

Texts count as UTF-8 bytes. Defined cases: null counts as empty; texts of under SPAN bytes lose
nothing; repeated rows are copies, so both go where they are long enough; a row's id may be null or
repeated. Extra columns are dropped. A document of any length is searched whole.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm._storage import discard, kept, salted_join
from fathom.llm._text import column_bytes, mix, pieces, powers, prefix_hash
from fathom.llm.suffix_sort import common, deep_shallow

SPAN, GRAM = 400, 32
#: Periods at which a gram counts as repeating itself.
PERIODS = 16
#: Anchors of one gram beyond which they are dealt by what stands beside them.
HOT = 1000
_PLACE = np.uint64((1 << 31) - 1)


def repeats_itself(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """For each place, whether the gram there equals itself moved by 1 to PERIODS bytes."""
    out = np.zeros(max(0, len(data) - gram + 1), bool)
    for p in range(1, min(PERIODS, gram - 1) + 1):
        same, size, want = data[:-p] == data[p:], 1, gram - p
        while 2 * size <= want:
            same = same[:-size] & same[size:]
            size *= 2
        if size < want:
            same = same[: len(same) - (want - size)] & same[want - size :]
        out |= same[: len(out)]
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places within the row, hashes of their grams) for each row."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(data) < span:
        yield from (none for _ in range(len(offsets) - 1))
        return
    sums, (_, down) = prefix_hash(data), powers(len(data) + 1)
    hashes = mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
    rank = (hashes >> np.uint64(33)) << np.uint64(31)
    rank = (rank >> np.uint64(1)) & ~_PLACE | repeats_itself(data, gram).astype(np.uint64) << np.uint64(63)
    wide = span - gram + 1
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a < span:
            yield none
            continue
        n = b - a - gram + 1
        low = rank[a : a + n] | np.arange(n, dtype=np.uint64)
        padded = np.full(-(-n // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
        padded[:n] = low
        blocks = padded.reshape(-1, wide)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        named = np.minimum(back[: n - wide + 1], ahead[wide - 1 : n])
        places = (named & _PLACE).astype(np.int64)
        places = places[np.r_[True, places[1:] != places[:-1]]]
        yield places, hashes[a + places]


def stretches(left: list[bytes], right: list[bytes], span: int = SPAN) -> list[tuple[int, int]]:
    """For each anchor, how far to the left and to the right it is covered; (0, 0) where it has no partner.

    ``left`` holds the bytes before each anchor, reversed; ``right`` those from it on."""
    n = len(left)
    order, shared = deep_shallow(right)
    by_left, _ = deep_shallow(left)
    rank = [0] * n
    for r, i in enumerate(by_left):
        rank[i] = r
    out_left, out_right = [0] * n, [0] * n

    def meet(a: int, b: int, to_right: int) -> None:
        to_left = common(left[a], left[b])
        if to_left + to_right >= span:
            for i in (a, b):
                out_left[i] = max(out_left[i], to_left)
                out_right[i] = max(out_right[i], to_right)

    group = list(range(n))  # by place in the order: the first place of its set
    held = {p: [rank[order[p]]] for p in range(n)}

    def top(p: int) -> int:
        while group[p] != p:
            group[p] = group[group[p]]
            p = group[p]
        return p

    for p in sorted(range(1, n), key=lambda p: -shared[p]):
        if not shared[p]:
            break
        a, b = top(p - 1), top(p)
        small, large = (a, b) if len(held[a]) <= len(held[b]) else (b, a)
        into = held[large]
        for r in held.pop(small):
            at = bisect_left(into, r)
            if at:
                meet(by_left[r], by_left[into[at - 1]], shared[p])
            if at < len(into):
                meet(by_left[r], by_left[into[at]], shared[p])
            insort(into, r)
        group[small] = large
    return list(zip(out_left, out_right, strict=True))


def digest(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))


def signed(docs: DataFrame) -> DataFrame:
    """(digest, hash, place) of all anchors; docs: digest, text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for low, high in pieces(offsets):
                found = list(anchors(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]))
                ends = np.r_[0, np.cumsum([len(p) for p, _ in found])].astype(np.int32)
                places = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([p for p, _ in found]).astype(np.int32)))
                hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([h for _, h in found]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low), places, hashes], ["digest", "id", "places", "hashes"])

    return docs.select("digest", "text", "id").mapInArrow(work, "digest binary, id long, places array<int>, hashes array<long>")


def contexts(near: DataFrame) -> DataFrame:
    """(hash, part, digest, place, cut, bytes): what windows around an anchor reach, ``cut`` of it before the anchor. near: digest, text, found (place, hash, hot)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                key, raw = batch.column(0)[row].as_py(), batch.column(1)[row].as_py().encode("utf-8", "surrogatepass")
                rows = []
                for f in batch.column(2)[row].as_py():
                    place = f["place"]
                    start = max(0, place - (SPAN - GRAM))
                    around, cut = raw[start : place + SPAN], place - start
                    parts = [0]
                    if f["hot"]:
                        half = SPAN // 2
                        parts = [int.from_bytes(hashlib.blake2b(side + around[a:b], digest_size=8).digest(), "little", signed=True) for side, a, b in ((b"l", cut - half, cut), (b"r", cut, cut + half)) if a >= 0 and b <= len(around)]
                    rows += [(f["hash"], p, key, place, cut, around) for p in parts]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["hash", "part", "digest", "place", "cut", "around"])

    return near.select("digest", "text", "found").mapInArrow(work, "hash long, part long, digest binary, place int, cut int, around binary")


def covered(around: DataFrame) -> DataFrame:
    """(digest, start, end) of the repeats at each anchor."""

    def solve(rows: list[tuple]) -> Iterator[tuple]:
        unique: dict[tuple, list[tuple]] = {}
        for key, place, cut, raw in set(rows):
            unique.setdefault((cut, raw), []).append((key, place))
        names = list(unique)
        found = stretches([raw[:cut][::-1] for cut, raw in names], [raw[cut:] for cut, raw in names]) if len(names) > 1 else [(0, 0)] * len(names)
        for (cut, raw), (left, right) in zip(names, found, strict=True):
            if len(unique[cut, raw]) > 1 and len(raw) >= SPAN:
                left, right = cut, len(raw) - cut  # all of it stands elsewhere
            if right:
                for key, place in unique[cut, raw]:
                    yield key, place - left, place + right

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64()), strict=True)], ["digest", "start", "end"])

        for batch in batches:
            out = []
            for h, p, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (h, p) != now:
                    out += solve(held)
                    now, held = (h, p), []
                held.append(tuple(row))
            yield made(out)
        yield made(list(solve(held)))

    order = around.repartition("hash", "part").sortWithinPartitions("hash", "part")
    return order.mapInArrow(work, "digest binary, start long, end long")


def cut_out(near: DataFrame) -> DataFrame:
    """(digest, n_removed, n_spans, kept): near has digest, text and spans (start, end)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                raw = batch.column(1)[row].as_py().encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for s in sorted((s["start"], s["end"]) for s in batch.column(2)[row].as_py()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                ends = [0, *(x for s in merged for x in s), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                out.append((batch.column(0)[row].as_py(), len(raw) - len(left), len(merged), left))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["digest", "n_removed", "n_spans", "kept"])

    return near.select("digest", "text", "spans").mapInArrow(work, "digest binary, n_removed long, n_spans long, kept binary")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", with_kept: bool = True) -> DataFrame:
    """(``key``, n_bytes, n_removed, n_spans, kept_sha256) for every row, and ``kept``, the remaining bytes, if asked for."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    rows = docs.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("digest", digest(F.col("text")))
    long = rows.where(F.octet_length("text") >= SPAN)
    copies = kept(long.groupBy("digest").agg(F.count("*").alias("copies"), F.min(F.col("id").cast("long")).alias("first")), "copies")
    sign = signed(long.withColumn("id", F.col("id").cast("long")))
    one = sign.join(copies, "digest").where(F.col("id").eqNullSafe(F.col("first"))).dropDuplicates(["digest"])
    marks = kept(one.select("digest", F.explode(F.arrays_zip("places", "hashes")).alias("m")).select("digest", F.col("m.places").alias("place"), F.col("m.hashes").alias("hash")), "anchors", "lz4")
    counts = kept(marks.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "counts", "lz4")
    hits = salted_join(marks, counts, "hash", ["digest", "place"], hot=HOT).groupBy("digest").agg(F.collect_list(F.struct("place", "hash", (F.col("n") > HOT).alias("hot"))).alias("found"))
    near = long.join(hits.join(copies, "digest"), "digest").where(F.col("id").cast("long").eqNullSafe(F.col("first"))).dropDuplicates(["digest"])
    near = kept(near.select("digest", "text", "found"), "near")
    spans = covered(contexts(near)).groupBy("digest").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    cuts = cut_out(near.select("digest", "text").join(spans, "digest"))
    cuts = cuts.select("digest", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"), *["kept"] * with_kept)
    fate = kept(copies.join(cuts, "digest", "left").where("copies > 1 OR n_removed IS NOT NULL").drop("first"), "fate")
    discard(marks, counts, near, copies)
    out = rows.select("id", "digest", raw.alias("raw"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("own"))
    out = (out if with_kept else out.drop("raw")).join(fate, "digest", "left")
    gone = F.coalesce(F.col("copies") > 1, F.lit(False))
    return out.select(
        F.col("id").alias(key), "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("sha", "own")).alias("kept_sha256"),
        *[F.when(gone, F.lit(b"")).otherwise(F.coalesce("kept", "raw")).alias("kept")] * with_kept,
    )
