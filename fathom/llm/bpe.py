"""Byte-level BPE: ranked merges over distinct words, and the way back.

A text is cut by a pattern; each piece starts as its bytes, and the adjacent pair whose joined
bytes have the lowest rank is merged until no pair has one, leftmost first. Two forms exist:

* ``fold_words``: Spark higher-order functions fold the merges over a table of distinct words. Its
  rank map is a literal: an array of hash buckets, because a literal map is searched key by key.
* ``encode``/``encode_batch``: the same fold over the distinct words of an Arrow batch, all words of
  it at once in numpy, then each document's ids are gathered. A corpus needs this form: see the
  README for what the first one measured.

Defined cases: null counts as empty text, which has no ids and decodes to no bytes. Repeated rows
are encoded alike and all kept. A text of any length is encoded whole. An empty table gives an
empty result. Extra columns are dropped unless named in ``keep``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm._text import column_bytes, pieces

#: Bytes of text of which the distinct words are folded together.
CHUNK = 1 << 20
#: A word of more bytes is folded alone.
LONG = 48
#: Distinct words that a worker keeps folded.
KEPT = 150_000
#: Bytes of text whose ids are given on together.
TEXT = 2 << 20
SCHEMA = "n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"


class Vocabulary:
    """Ranks of byte strings. ``pair_rank`` finds what two adjacent ids merge to, or -1."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.size = max(ranks.values(), default=-1) + 1
        self.bytes_of = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.text_of = [str(i) for i in range(self.size)]
        self.of_byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        found = []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found.append((left * self.size + right, rank))
        found.sort()
        self._hashed(np.array([k for k, _ in found], np.int64), np.array([r for _, r in found], np.int32))

    def _hashed(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressing table; probes stop at an empty slot."""
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[slot[left]] == -1
            first = np.unique(slot[left][free], return_index=True)[1]
            put = left[free][first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], -1)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(read_ranks(path))


@lru_cache(maxsize=4)
def splitter(pattern: str):
    """A function that lists a text's matches. The common case is a text within the basic plane: the
    standard engine, with the pattern's classes spelled out as ranges, is several times as fast there."""
    import regex

    general = regex.compile(pattern).findall
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def ranges(name: str) -> str:
        return "".join(f"\\u{ord(m[0]):04x}-\\u{ord(m[-1]):04x}" for m in regex.findall(rf"{name}+", plane) for m in runs(m))

    def runs(m: str) -> list[str]:  # code points that follow one another, also across the surrogates' gap
        return [x for x in (m if m[0] > "\ud7ff" or m[-1] < "\ue000" else "",) if x] or [*filter(None, ("".join(c for c in m if c < "\ud800"), "".join(c for c in m if c > "\udfff")))]

    out, inside, at = "", False, 0
    while at < len(pattern):
        if m := re.match(r"\\p\{\w+\}|\\s", pattern[at:]):
            out += ranges(m[0]) if inside else f"[{ranges(m[0])}]"
        elif m := re.match(r"\\S", pattern[at:]):
            if inside:
                return general
            out += f"[^{ranges(r'\s')}]"
        else:
            m = re.match(r"\\.|.", pattern[at:], re.S)
            inside = (inside or m[0] == "[") and m[0] != "]"
            out += m[0]
        at += m.end()
    try:
        fast, beyond = re.compile(out).findall, re.compile("[\ud800-\udfff\U00010000-\U0010ffff]").search
    except re.error:
        return general
    return lambda text: (general if beyond(text) else fast)(text)


def fold_long(word: bytes, vocab: Vocabulary) -> list[int]:
    """The ids of one word in n log n steps: a heap of pairs by rank and place over a linked list of parts."""
    ranks = vocab.ranks
    end = len(word)
    nxt, prev = list(range(1, end + 1)), list(range(-1, end - 1))
    heap = [(r, i, i + 2) for i in range(end - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\x01") * end
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i] if alive[i] else end
        if j >= end or nxt[j] != stop:
            continue  # one of the two parts has changed since
        alive[j] = 0
        nxt[i] = stop
        if stop < end:
            prev[stop] = i
            if (r := ranks.get(word[i : nxt[stop]])) is not None:
                heapq.heappush(heap, (r, i, nxt[stop]))
        if (p := prev[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    i, out = 0, []
    while i < end:
        out.append(ranks[word[i : nxt[i]]])
        i = nxt[i]
    return out


def fold(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after another, and the n + 1 offsets of the words. Every round merges in each word its best pair."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    done_ids: list[np.ndarray] = []
    done_word: list[np.ndarray] = []
    ids = vocab.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), sizes)
    pair = np.full(len(ids), -1, np.int32)
    if len(ids) > 1:
        at = np.flatnonzero(word[1:] == word[:-1])
        pair[at] = vocab.pair_rank(ids[at], ids[at + 1])
    none = np.iinfo(np.int32).max
    while len(ids):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        score = np.where(pair < 0, none, pair)
        best = np.minimum.reduceat(score, starts)
        length = np.diff(np.r_[starts, len(ids)])
        live = best < none
        if not live.all():
            stay = np.repeat(live, length)
            done_ids.append(ids[~stay])
            done_word.append(word[~stay])
            ids, word, pair, score = ids[stay], word[stay], pair[stay], score[stay]
            best, length = best[live], length[live]
            if not len(ids):
                break
            starts = np.r_[0, np.cumsum(length)[:-1]]
        hits = np.flatnonzero(score == np.repeat(best, length))
        merge = hits[np.r_[True, word[hits[1:]] != word[hits[:-1]]]]
        ids[merge] = pair[merge]
        keep = np.ones(len(ids), bool)
        keep[merge + 1] = False
        place = np.cumsum(keep) - 1
        ids, word, pair = ids[keep], word[keep], pair[keep]
        at = place[merge]
        near = np.r_[at, at[at > 0] - 1]
        inside = near[near < len(ids) - 1]
        pair[near] = -1
        inside = inside[word[inside] == word[inside + 1]]
        pair[inside] = vocab.pair_rank(ids[inside], ids[inside + 1])
    all_ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64)
    all_word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
    order = np.argsort(all_word, kind="stable")
    offsets = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.bincount(all_word, minlength=len(words)), out=offsets[1:])
    return all_ids[order], offsets


def fold_all(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """``fold``, with words of over LONG bytes taken one by one."""
    ids, offsets = fold([w if len(w) <= LONG else b"" for w in words], vocab)
    long = [i for i, w in enumerate(words) if len(w) > LONG]
    if not long:
        return ids, offsets
    found = [fold_long(words[i], vocab) for i in long]
    sizes = np.diff(offsets)
    cuts = offsets[long]
    parts = [x for a, b, f in zip(np.r_[0, cuts[:-1]], cuts, found, strict=True) for x in (ids[a:b], np.array(f, np.int64))]
    sizes[long] = [len(f) for f in found]
    return np.concatenate([*parts, ids[cuts[-1] :]]), np.r_[0, np.cumsum(sizes)]


class Words(dict):
    """Numbers distinct words in order of arrival and keeps the ids of those folded so far."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.new: list[str] = []
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def fold_new(self) -> None:
        ids, offsets = fold_all([w.encode("utf-8", "surrogatepass") for w in self.new], self.vocab)
        self.new = []
        self.starts = np.concatenate([self.starts, offsets[:-1] + len(self.ids)])
        self.sizes = np.concatenate([self.sizes, np.diff(offsets)])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])


def encode_batch(texts: list[str | None], words: Words, pattern: str) -> Iterator[np.ndarray]:
    """The ids of each text. ``words`` is kept from batch to batch, up to KEPT words."""
    find, low = splitter(pattern), 0
    while low < len(texts):
        if len(words) > KEPT:
            words.__init__(words.vocab)
            words.clear()
        seen, counts, size, high = [], [], 0, low
        while high < len(texts) and (high == low or size < CHUNK):
            text = texts[high] or ""
            parts = find(text)
            size += len(text)
            seen.extend(map(words.__getitem__, parts))
            counts.append(len(parts))
            high += 1
        words.fold_new()
        at = np.array(seen, np.int64)
        length = words.sizes[at]
        total = np.zeros(len(at) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        flat = words.ids[np.arange(total[-1]) + np.repeat(words.starts[at] - total[:-1], length)]
        ends = total[np.r_[0, np.cumsum(counts)]]
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield flat[a:b]
        low = high


def decode_ids(ids: list[int], vocab: Vocabulary) -> bytes:
    """The bytes of the ids' tokens, one after another."""
    return b"".join(map(vocab.bytes_of.__getitem__, ids))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """Columns ``keep``, then n_tokens, ids (if asked for) and the digests of the ids and of their decoding."""
    kept = df.select(*[F.col(f"`{c}`") for c in keep]).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(c for c in SCHEMA.split(", ") if with_ids or not c.startswith("ids array"))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(vocab := vocabulary(path))
        for batch in batches:
            for low, high in pieces(column_bytes(batch.column(0))[1], TEXT):
                part = batch.slice(low, high - low)
                n, all_ids, id_hash, text_hash = [], [], [], []
                for found in encode_batch(part.column(0).to_pylist(), words, pattern):
                    ids = found.tolist()
                    n.append(len(ids))
                    if with_ids:
                        all_ids.append(found.astype(np.int32))
                    id_hash.append(hashlib.sha256(",".join(map(vocab.text_of.__getitem__, ids)).encode()).hexdigest())
                    text_hash.append(hashlib.sha256(decode_ids(ids, vocab)).hexdigest())
                made = [pa.array(n, pa.int64()), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    made.insert(1, pa.array(all_ids, pa.list_(pa.int32())))
                    names.insert(1, "ids")
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], [*keep, *names])

    return df.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(work, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``decoded``, the bytes of the ids; null ids give no bytes."""
    kept = df.select(*[F.col(f"`{c}`") for c in keep]).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "decoded binary"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            made = [decode_ids(x or [], vocab) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(made, pa.binary())], [*keep, "decoded"])

    return df.select(F.col(f"`{ids}`").alias("_ids"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(work, schema)


def rank_literal(ranks: dict[bytes, int], buckets: int) -> Column:
    """The rank map as a literal array of buckets: what a byte string hashes to holds it and its rank."""
    held: list[list[tuple[str, int]]] = [[] for _ in range(buckets)]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        held[_bucket(token, buckets)].append((token.hex(), rank))
    rows = ", ".join("array(" + ", ".join(f"named_struct('k', X'{k}', 'r', {r})" for k, r in b) + ")" if b else "array()" for b in held)
    return F.expr(f"cast(array({rows}) as array<array<struct<k:binary,r:int>>>)")


def _bucket(token: bytes, buckets: int) -> int:
    import zlib

    return zlib.crc32(token) % buckets


def fold_words(words: DataFrame, ranks: dict[bytes, int], word: str = "word", buckets: int = 0) -> DataFrame:
    """A table of distinct words (binary) with ``ids``, folded by Spark's higher-order functions.

    State: the parts of the word. One step for each byte but the first merges the pair with the
    lowest rank, the leftmost on ties; a step without such a pair changes nothing."""
    table = rank_literal(ranks, buckets := buckets or max(1, len(ranks)))
    spark_rank = lambda b: F.try_element_at(
        F.transform(F.filter(F.element_at(table, (F.crc32(b) % buckets + 1).cast("int")), lambda e: e["k"] == b), lambda e: e["r"]), F.lit(1)
    )
    size = F.octet_length(F.col(word))
    letters = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substring(F.col(word), i, F.lit(1)))
    none = F.lit(2**31 - 1)

    def step(parts: Column, _: Column) -> Column:
        pairs = F.transform(
            F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))),
            lambda p, i: F.struct(F.coalesce(spark_rank(F.concat(p, F.element_at(parts, (i + 2).cast("int")))), none).alias("r"), i.alias("i")),
        )
        best = F.array_min(pairs)
        merged = F.concat(
            F.slice(parts, F.lit(1), best["i"]),
            F.array(F.concat(F.element_at(parts, best["i"] + 1), F.element_at(parts, best["i"] + 2))),
            F.slice(parts, best["i"] + 3, F.size(parts)),
        )
        return F.when((F.size(parts) > 1) & (best["r"] < none), merged).otherwise(parts)

    parts = F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), letters, step)
    return words.withColumn("ids", F.when(size > 0, F.transform(parts, spark_rank)).otherwise(F.array().cast("array<int>")))
