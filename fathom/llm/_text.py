"""Vectorised helpers over the bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240607)
#: A random 64-bit value for each byte, and the odd base of the prefix hash.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
#: Odd multipliers for the words of a shingle.
PLACE = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int = 512 << 10) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer row comes alone."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high
        low = high


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64 for i < n, kept for the next call."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        inverse = pow(BASE, -1, 2**64)
        out = []
        for base in (BASE, inverse):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            out.append(np.cumprod(step, dtype=np.uint64))
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 running sums from which ``span_hash`` takes the hash of any span."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[:-1], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), the same wherever a span stands."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of all rows, and the first word of each row."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    edge[1:n] = space[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(~space & edge[:n])
    edge[:n] = space
    edge[n] = True
    after = edge[1:].copy()
    inner = offsets[(offsets > 0) & (offsets <= n)]
    after[inner - 1] = True
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased, and the first word of each row."""
    low = LOWER[data]
    starts, ends, first = find_words(low, offsets)
    return span_hash(prefix_hash(low), starts, ends), first


def shingles(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles, repeats included, and the first shingle of each row.

    A row of fewer words has one shingle, its whole sequence; a row without words none."""
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    bounds = np.zeros(len(first), np.int64)
    np.cumsum(n, out=bounds[1:])
    if not len(words):
        return np.zeros(0, np.uint64), bounds
    total = np.zeros(len(words) + k, np.uint64)
    padded = np.zeros(len(words) + k, np.uint64)
    padded[: len(words)] = words
    for j in range(k):
        total[: len(words)] += padded[j : j + len(words)] * PLACE[j]
    keep = np.repeat(first[:-1], n) + (np.arange(bounds[-1]) - np.repeat(bounds[:-1], n))
    out = total[keep]
    for row in np.flatnonzero((count > 0) & (count < k)):
        w = words[first[row] : first[row + 1]]
        out[bounds[row]] = np.uint64(len(w)) + (w * PLACE[: len(w)]).sum(dtype=np.uint64)
    return mix(out), bounds
