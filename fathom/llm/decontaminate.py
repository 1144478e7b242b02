"""Benchmark decontamination by pigeonhole edit matching.

A document is contaminated by a test item where some part of its text is within the item's error
budget: one edit (insertion, deletion, replacement) for every ERROR_EVERY bytes, after A-Z are
lower-cased. An item with k edits to spend is split into k + 1 pieces; at least one piece stands
unharmed in any match. Eight bytes of every piece are looked up at every position of a text at once,
whole pieces are compared where these hit, and around such hits Myers' bit-parallel algorithm takes
the least edit distance of the item to any part of the text. Hits whose surroundings overlap are
searched as one stretch, so the work on a text never exceeds its length for an item.

The items are a stated query set: they are searched for in all documents, in blocks of BLOCK bytes.
Defined cases: null or empty items match nothing, and items without an id are left out, null or empty texts hold nothing; items of equal
text are all reported; items of under 16 bytes are matched without edits. Repeated rows are all
kept and judged alike. Extra columns are kept by ``clean`` and dropped by ``find`` unless in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm._storage import renamed
from fathom.llm._text import LOWER, column_bytes, pieces
from fathom.llm.quality import df_schema

ERROR_EVERY = 16
BLOCK = 8 << 20
BITS = 22
#: Bytes of text that are searched before their rows are given on.
TEXT = 4 << 20
MATCHES = "matches array<struct<item_id:long,distance:int,end:long>>"
_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int64())]))
_MULT = np.uint64(0x9E3779B97F4A7C15)


def lowered(text: str) -> bytes:
    return LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].tobytes()


def budget(item: bytes) -> int:
    return len(item) // ERROR_EVERY


def keys_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number."""
    n = max(0, len(data) - 7)
    out = np.empty(n, np.uint64)
    for j in range(min(8, n)):
        m = (n - j + 7) // 8
        out[j::8] = np.frombuffer(data[j : j + 8 * m].tobytes(), "<u8")
    return out


def myers(item: bytes, masks: dict[int, int], text: bytes, most: int) -> tuple[int, int] | None:
    """(distance, end) of the part of ``text`` nearest to ``item``, the first of equals; None beyond ``most``.

    Columns of the edit matrix are kept as differences, a bit for each byte of the item."""
    m = len(item)
    ones, top = (1 << m) - 1, 1 << (m - 1)
    up, down, now, best, where = ones, 0, m, most + 1, 0
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right = down | (ones & ~(diagonal | up))
        left = up & diagonal
        if right & top:
            now += 1
        elif left & top:
            now -= 1
        right = right << 1 & ones
        left = left << 1 & ones
        up = left | (ones & ~((eq | down) | right))
        down = (eq | down) & right
        if now < best:
            best, where = now, i + 1
            if not best:
                break
    return (best, where) if best <= most else None


class Items:
    """A block of items, ready to be searched for."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        ids: dict[bytes, list[int]] = {}
        for item_id, text in rows:
            if text:
                ids.setdefault(lowered(text), []).append(item_id)
        self.texts = sorted(ids)
        self.ids = [sorted(set(ids[t])) for t in self.texts]
        self.short = [i for i, t in enumerate(self.texts) if len(t) < 8]
        self.masks = []
        parts = []
        for i, t in enumerate(self.texts):
            at: dict[int, int] = {}
            for j, c in enumerate(t):
                at[c] = at.get(c, 0) | 1 << j
            self.masks.append(at)
            if len(t) >= 8:
                k = budget(t) + 1
                cuts = [len(t) * x // k for x in range(k + 1)]
                parts += [(int.from_bytes(t[a : a + 8], "little"), i, a, t[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        parts.sort()
        self.parts = parts
        self.keys = np.array([p[0] for p in parts], np.uint64)
        self.maybe = np.zeros(1 << BITS, bool)
        self.maybe[(self.keys * _MULT) >> np.uint64(64 - BITS)] = True

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """(item, distance, end) of the best match of each item in each row."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
        raw = data.tobytes()
        near: dict[tuple[int, int], list[int]] = {}
        if len(self.keys):
            keys = keys_of(data)
            hits = np.flatnonzero(self.maybe[(keys * _MULT) >> np.uint64(64 - BITS)])
            first = np.searchsorted(self.keys, keys[hits], "left")
            last = np.searchsorted(self.keys, keys[hits], "right")
            real = last > first
            rows = np.searchsorted(offsets, hits, "right") - 1
            for p, row, a, b in zip(hits[real].tolist(), rows[real].tolist(), first[real].tolist(), last[real].tolist(), strict=True):
                end = int(offsets[row + 1])
                for _, i, at, part in self.parts[a:b]:
                    if p + len(part) <= end and raw.startswith(part, p):
                        near.setdefault((row, i), []).append(p - at)
        for (row, i), starts in near.items():
            low, high = int(offsets[row]), int(offsets[row + 1])
            if (found := self._best(raw, low, high, i, sorted(set(starts)))) is not None:
                out[row].append((i, found[0], found[1] - low))
        for i in self.short:
            at = raw.find(self.texts[i])
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(self.texts[i]) <= offsets[row + 1]:
                    out[row].append((i, 0, at + len(self.texts[i]) - int(offsets[row])))
                    at = raw.find(self.texts[i], int(offsets[row + 1]))
                else:
                    at = raw.find(self.texts[i], at + 1)
        return out

    def _best(self, raw: bytes, low: int, high: int, i: int, starts: list[int]) -> tuple[int, int] | None:
        item = self.texts[i]
        k, m = budget(item), len(item)
        for s in starts:
            if s >= low and s + m <= high and raw.startswith(item, s):
                return 0, s + m
        best = None
        at = 0
        while at < len(starts):
            a, b = max(low, starts[at] - k), min(high, starts[at] + m + k)
            at += 1
            while at < len(starts) and starts[at] - k <= b:
                b = min(high, starts[at] + m + k)
                at += 1
            found = myers(item, self.masks[i], raw[a:b], k if best is None else best[0] - 1)
            if found:
                best = (found[0], a + found[1])
        return best


def blocks_of(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    held, size = [], 0
    for r in items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL AND t <> ''").orderBy("i", "t").toLocalIterator():
        held.append((r["i"], r["t"]))
        size += len(r["t"])
        if size >= BLOCK:
            yield held
            held, size = [], 0
    yield held


def _matches(batch_text, found: Items) -> list[list[dict]]:
    data, offsets = column_bytes(batch_text)
    out: list[list[dict]] = []
    for low, high in pieces(offsets):
        part = LOWER[data[offsets[low] : offsets[high]]]
        for row in found.search(part, offsets[low : high + 1] - offsets[low]):
            out.append(sorted(({"item_id": x, "distance": d, "end": e} for i, d, e in row for x in found.ids[i]), key=lambda m: m["item_id"]))
    return out


def matched(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``matches``, replacing a column of that name: for each item found its least distance and where that part ends, in bytes."""
    out = docs.drop("matches")
    place = out.columns.index(text)
    names = [*out.columns, "matches"]
    for n, rows in enumerate(blocks_of(items, item_id, item_text)):
        schema = f"{df_schema(docs.drop('matches'), tuple(names[:-1]))}, {MATCHES}"

        def work(batches: Iterator[pa.RecordBatch], rows=rows, more=n > 0) -> Iterator[pa.RecordBatch]:
            found = Items(rows)
            for batch in batches:
                for low, high in pieces(column_bytes(batch.column(place))[1], TEXT):
                    part = batch.slice(low, high - low)
                    made = _matches(part.column(place), found)
                    if more:
                        made = [a + b for a, b in zip(part.column(part.num_columns - 1).to_pylist(), made, strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(names) - 1], pa.array(made, _MATCH)], names)

        out = out.mapInArrow(work, schema)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no item contaminates, with their columns, whatever these are called."""
    inner, back = renamed(docs, (text,))
    return back(matched(inner, items, text).where(F.size("matches") == 0))
