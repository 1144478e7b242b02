"""Media columns: telephony audio as files in a binary column.

``store`` lays bytes down as the samples of a WAVE file (one channel, 8000 a second): G.711 mu-law
or A-law, whose unit is the 8-bit sample, or IMA ADPCM, whose unit is a block of BLOCK bytes with two
samples in a byte. ``load`` parses such files, gives back the stored bytes, expands mu-law and A-law
by lookup tables, decodes ADPCM for all blocks of a batch side by side, one numpy step a sample, and
resamples to 16-bit PCM by linear interpolation in whole numbers: a column to be stored, which ``described`` reads.

Defined cases: null counts as empty; a payload is filled up with zero bytes to a positive multiple
of BLOCK, so an empty one is one block of zeros. Equal payloads make equal files. A file that is
none of these loads as null. Repeated rows are all kept; extra columns are dropped unless named in
``keep``. A long text is one long file; batches are cut by bytes, so that what is decoded at once is bounded by the longest.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm._text import column_bytes, pieces
from fathom.llm.quality import df_schema

BLOCK = 64
RATE = 8000
#: WAVE format tags.
MULAW, ALAW, ADPCM = 7, 6, 0x11
CODECS = (MULAW, ALAW, ADPCM)
NAMES = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "adpcm"}


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    segment = code >> 4 & 7
    base = ((code & 15) << 4) + 8
    size = np.where(segment == 0, base, base + 256 << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


# Fixed values of the IMA ADPCM format: its step sizes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MULAW_PCM, ALAW_PCM = _mulaw_table(), _alaw_table()
#: How the step index moves by the three low bits of a code. Fixed values of the format.
INDEX_MOVE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """(n, BLOCK) bytes to (n, 1 + 2 * (BLOCK - 4)) samples. A block starts with its first sample, its step index and an unused byte."""
    n = len(blocks)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out = np.empty((1 + 2 * (blocks.shape[1] - 4), n), np.int16)
    out[0] = value
    for i in range(blocks.shape[1] - 4):
        byte = blocks[:, 4 + i]
        for half, code in enumerate((byte & 15, byte >> 4)):
            step = STEPS[index]
            size = (code & 7).astype(np.int32)
            delta = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
            value = np.clip(np.where(code & 8, value - delta, value + delta), -32768, 32767)
            index = np.clip(index + INDEX_MOVE[size], 0, 88)
            out[1 + 2 * i + half] = value
    return out.T


def pad(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % BLOCK if payload else BLOCK)


def to_file(payload: bytes, codec: int) -> bytes:
    """A WAVE file whose data are ``payload``."""
    align, bits = (BLOCK, 4) if codec == ADPCM else (1, 8)
    per_block = 1 + 2 * (BLOCK - 4)
    rate = RATE * BLOCK // per_block if codec == ADPCM else RATE
    extra = struct.pack("<HH", 2, per_block) if codec == ADPCM else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", codec, 1, RATE, rate, align, bits) + extra
    samples = len(payload) // BLOCK * per_block if codec == ADPCM else len(payload)
    chunks = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(chunks)) + chunks


def from_file(media: bytes) -> tuple[int, int, bytes] | None:
    """Codec, samples a second and the stored bytes; None for anything but a whole file of these codecs."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, codec, rate = 12, 0, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if kind == b"fmt " and size >= 16:
            codec, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif kind == b"data":
            whole = at + 8 + size <= len(media) and codec in CODECS
            return (codec, rate, media[at + 8 : at + 8 + size]) if whole else None
        at += 8 + size + size % 2
    return None


def to_pcm(files: list[tuple[int, int, bytes] | None]) -> list[np.ndarray]:
    """16-bit samples of each file; all ADPCM blocks of the list are decoded together."""
    blocks = [np.frombuffer(f[2][: len(f[2]) // BLOCK * BLOCK], np.uint8).reshape(-1, BLOCK) for f in files if f and f[0] == ADPCM]
    decoded = adpcm_decode(np.concatenate(blocks)) if blocks else None
    out, at = [], 0
    for f in files:
        if f is None:
            out.append(np.zeros(0, np.int16))
        elif f[0] == ADPCM:
            n = len(f[2]) // BLOCK
            out.append(decoded[at : at + n].reshape(-1))
            at += n
        else:
            out.append((MULAW_PCM if f[0] == MULAW else ALAW_PCM)[np.frombuffer(f[2], np.uint8)])
    return out


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in 64-bit whole numbers: the same on every machine."""
    if rate == to or not len(pcm):
        return pcm.astype(np.int16)
    n = len(pcm) * to // rate
    place = np.arange(n, dtype=np.int64) * rate
    low = place // to
    part = place - low * to
    high = np.minimum(low + 1, len(pcm) - 1)
    x = pcm.astype(np.int64)
    return ((x[low] * (to - part) + x[high] * part) // to).astype(np.int16)


def feature(codec: str, pcm: np.ndarray, rate: int) -> str:
    """Whole-number features of resampled sound: length, level, peak, zero crossings, digest of the samples."""
    x = pcm.astype(np.int64)
    rms = int(np.sqrt(int((x * x).sum()) // max(1, len(x))))
    cross = int((np.signbit(pcm[1:]) != np.signbit(pcm[:-1])).sum())
    return f"{codec} rate={rate} n={len(x)} rms={rms} peak={int(np.abs(x).max(initial=0))} crossings={cross} crc32={zlib.crc32(pcm.astype('<i2').tobytes())}"


def codec_of(payload: bytes, codec: int | None) -> int:
    """The codec asked for, or one that the payload itself picks."""
    return codec or CODECS[zlib.crc32(payload) % len(CODECS)]


def store(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), codec: int | None = None) -> DataFrame:
    """Columns ``keep``, n_bytes (before filling up) and media, the file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            for low, high in pieces(offsets, TOGETHER):
                raw = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(low, high)]
                files = [to_file(p, codec_of(p, codec)) for p in map(pad, raw)]
                made = [pa.array(map(len, raw), pa.int64()), pa.array(files, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in batch.columns[1:]), *made], [*keep, "n_bytes", "media"])

    cols = [F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`") for c in keep]]
    return df.select(*cols).mapInArrow(work, f"{df_schema(df, keep)}, n_bytes long, media binary")


#: Bytes of files decoded, or of samples described, at once.
TOGETHER = 1 << 20
LOADED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, pcm binary"


def _by_bytes(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about TOGETHER bytes of a binary column; a longer value comes alone."""
    return pieces(column_bytes(column)[1], TOGETHER)


def load(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",), rate: int = 16000) -> DataFrame:
    """Columns ``keep`` with digests of the stored bytes and of the file, the codec, and the sound resampled to ``rate``
    (pcm, 16-bit little-endian): what a table of sounds holds."""
    names = [*keep, *(c.split()[0] for c in LOADED.split(", "))]

    def rows(files: list[bytes | None]) -> Iterator[tuple]:
        parsed = [from_file(f) if f is not None else None for f in files]
        for f, p, pcm in zip(files, parsed, to_pcm(parsed), strict=True):
            size, digest = (len(f), hashlib.sha256(f).hexdigest()) if f is not None else (None, None)
            if p is None:
                yield None, None, None, size, digest, None, None
            else:
                sound = resample(pcm, p[1], rate).astype("<i2").tobytes()
                yield len(p[2]), hashlib.sha256(p[2]).hexdigest(), zlib.crc32(p[2][-BLOCK:]), size, digest, NAMES[p[0]], sound

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for low, high in _by_bytes(batch.column(0)):
                made = zip(*rows(batch.column(0).slice(low, high - low).to_pylist()), strict=True)
                columns = [pa.array(c, k) for c, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in batch.columns[1:]), *columns], names)

    return df.select(F.col(f"`{media}`").alias("_media"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(work, f"{df_schema(df, keep)}, {LOADED}")


def described(df: DataFrame, rate: int = 16000, pcm: str = "pcm", codec: str = "codec") -> DataFrame:
    """``df`` without ``pcm`` and ``codec``, with ``feature`` of the stored samples; null where there are none to read."""
    keep = tuple(c for c in df.columns if c not in (pcm, codec, "feature"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in _by_bytes(batch.column(0)):
                part = batch.slice(low, high - low)
                made = [None if x is None else feature(c, np.frombuffer(x, "<i2"), rate) for x, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(made, pa.string())], [*keep, "feature"])

    cols = [F.col(f"`{pcm}`").alias("_pcm"), F.col(f"`{codec}`").alias("_codec"), *[F.col(f"`{c}`") for c in keep]]
    return df.select(*cols).mapInArrow(work, f"{df_schema(df, keep)}, feature string")
