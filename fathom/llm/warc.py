"""WARC archives with a two-level capture index.

``write`` lays pages down as gzip members of ``.warc.gz`` files in a folder that all executors
share, one file a task, and keeps a row for each capture. ``build_index`` sorts the captures by
their reversed-host URL key and writes each range of keys as a segment: a file of compressed blocks of
BLOCK_LINES lines (first level) and a sparse directory with each block's keys and place (second
level). The segments themselves, one for each task that sorted, are the rows of a small table.
``look_up`` bisects the segments and their directories for every key, which tells the blocks that may
hold it; tasks then range-read each such block once and bisect it for its keys. ``read`` fetches
captures by range reads of the archives. A key of very many captures is many blocks, and so many tasks.

Payloads are the pages' html as UTF-8, null counting as empty. Of equal payloads of at least
``least`` bytes the one with the smallest page id is a response and the others are revisits that name
it; smaller payloads are all responses. Rows with the same smallest id are all responses; a null id
counts as the greatest. A null or odd URL is filed under its own text. Repeated rows are all kept;
an empty table gives empty archives and index. Extra columns are dropped.

Files are named at random by each attempt of a task and found through the rows that the task
returned, which are written before they are used: an attempt that was lost leaves a file that
nothing names. A payload of any size is one record; records are written one at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm._storage import kept, new_path, salted_join

BLOCK_LINES = 3000
#: Captures of one file within so many bytes are read by one task.
SPAN = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, url string, page_id long, type string, file string, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """``http://www.example.com:80/a?b`` to ``com,example,www:80)/a?b``: captures of a host and its subdomains sort together."""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", url or "", re.S)
    if not m:
        return url or ""
    host = ",".join(reversed(m[1].lower().split(".")))
    return f"{host}{m[2] or ''}){m[3] if m[3].startswith('/') else '/' + m[3]}"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def capture_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response, or a revisit that has the response's HTTP head but no payload."""
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields: list[tuple[str, object]] = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"[\r\n]+\s*", " ", url or "")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", page_id))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", refers_to)]
    return _record(fields, http if revisit else http + payload)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields, lower-cased, and the block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return fields, rest[: int(fields["content-length"])]


def _row(fields: dict[str, str], block: bytes) -> tuple:
    """What the archive says of a capture. A response's size and digest are taken from its payload, a revisit's from its fields."""
    page = int(fields["x-page-id"]) if "x-page-id" in fields else None
    head, _, payload = block.partition(b"\r\n\r\n")
    if fields["warc-type"] == "response":
        return page, len(payload), digest_of(payload), "response", None
    size = int(re.search(rb"(?i)^content-length: *(\d+)", head, re.M)[1])
    return page, size, fields["warc-payload-digest"].removeprefix("sha1:"), "revisit", int(fields["x-refers-to-page-id"])


def revisits(pages: DataFrame, least: int, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, digest, refers_to) of all but the first of equal payloads. Ids and digests alone are shuffled."""
    own = pages.select(F.col(page_id).alias("page_id"), F.coalesce(html, F.lit("")).alias("h"))
    own = own.where(F.octet_length("h") >= least).select("page_id", F.sha1(F.encode("h", "UTF-8")).alias("digest"))
    groups = own.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    return salted_join(own, kept(groups, "digests"), "digest", ["page_id"]).where("page_id IS NULL OR page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archives in the shared folder; the result is the table of captures (CAPTURE)."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    others = kept(revisits(pages, least, page_id, html), "revisits").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    rows = rows.join(others, F.col("page_id").eqNullSafe(F.col("_id")) & (F.sha1(F.encode("html", "UTF-8")) == F.col("_digest")), "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name, at, out = f"part-{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in batches:
                found = []
                for i in range(batch.num_rows):
                    page, link, text, refers = (batch.column(c)[i].as_py() for c in range(4))
                    if out is None:
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                        info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                        out.write(member := gzip.compress(info, 6, mtime=0))
                        at = len(member)
                    payload = text.encode()
                    out.write(member := gzip.compress(capture_record(page, link, payload, refers, refers is not None), 6, mtime=0))
                    found.append((url_key(link), link, page, "response" if refers is None else "revisit", name, at, len(member)))
                    at += len(member)
                yield _batch(found, CAPTURE)
        finally:
            if out is not None:
                out.close()

    made = rows.select("page_id", "url", "html", "refers_to").mapInArrow(work, CAPTURE)
    return kept(made, "captures").withColumn("folder", F.lit(folder))


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    parts = [c.split() for c in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in parts]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, parts, strict=True)], [n for n, _ in parts])


SEGMENT = "folder string, segment string, first_key string, last_key string, blocks long, lines long"
LINE = "key string, page_id long, type string, folder string, file string, offset long, length long"
#: Lines that a task gives on at once.
BATCH = 2000


def build_index(captures: DataFrame, lines: int = BLOCK_LINES) -> DataFrame:
    """The table of segments (SEGMENT): their blocks and directories are files in the shared folder, named by attempt."""
    folder = new_path(captures.sparkSession, "cdx")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name, at, out, held, places, total = uuid.uuid4().hex, 0, None, [], [], 0

        def block() -> None:
            nonlocal at, out, held
            if out is None:
                out = system.open_output_stream(f"{base}/{name}.cdx", compression=None)
            data = zlib.compress("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in held).encode("utf-8", "surrogatepass"), 6)
            out.write(data)
            places.append((held[0][0], held[-1][0], at, len(data)))
            at, held = at + len(data), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                total += 1
                if len(held) == lines:
                    block()
        if held:
            block()
        if out is not None:
            out.close()
            with system.open_output_stream(f"{base}/{name}.dir", compression=None) as f:
                f.write(zlib.compress("".join(json.dumps(p, ensure_ascii=False) + "\n" for p in places).encode("utf-8", "surrogatepass"), 6))
            yield _batch([(folder, name, places[0][0], places[-1][1], len(places), total)], SEGMENT)

    order = captures.select("key", "page_id", "type", "folder", "file", "offset", "length").repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return kept(order.mapInArrow(work, SEGMENT), "segments")


def spanning(firsts: list[str], lasts: list[str], key: str) -> range:
    """Which of some sorted ranges may hold a key, by bisection; a key's lines may go on over several."""
    return range(bisect_left(lasts, key), bisect_right(firsts, key))


def _read_at(folder: str, name: str, offset: int = 0, length: int | None = None) -> bytes:
    system, base = pafs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{base}/{name}") as f:
        return f.read_at(f.size() if length is None else length, offset)


def url_keys(urls: DataFrame, url: str = "url") -> DataFrame:
    """The distinct keys (key) of a table of URLs; null and odd URLs have keys of their own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(x) for x in batch.column(0).to_pylist()], pa.string())], ["key"])

    return urls.select(F.col(f"`{url}`").alias("_url")).distinct().mapInArrow(work, "key string").distinct()


def look_up(keys: DataFrame, segments: DataFrame) -> DataFrame:
    """The index lines (LINE) of a table of distinct keys.

    The segments' table has a row for each task of the sort, so it goes to all tasks; a directory is read by the tasks
    whose keys fall into it, one at a time."""
    root = sorted((r["first_key"], r["last_key"], r["folder"], r["segment"]) for r in segments.collect())
    firsts, lasts = [r[0] for r in root], [r[1] for r in root]

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, places, starts, ends = -1, [], [], []
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                for i in spanning(firsts, lasts, key):
                    if i != now:
                        now, places = i, _lines(_read_at(root[i][2], f"{root[i][3]}.dir"))
                        starts, ends = [p[0] for p in places], [p[1] for p in places]
                    for j in spanning(starts, ends, key):
                        out.append((key, root[i][2], root[i][3], places[j][2], places[j][3]))
            yield _batch(out, "key string, folder string, segment string, offset long, length long")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, names = None, [], []
        for batch in batches:
            out: list[tuple] = []
            for key, *place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != now:
                    folder, segment, offset, length = now = place
                    block = _lines(_read_at(folder, f"{segment}.cdx", offset, length))
                    names = [x[0] for x in block]
                out += map(tuple, block[bisect_left(names, key) : bisect_right(names, key)])
                if len(out) >= BATCH:
                    yield _batch(out, LINE)
                    out = []
            yield _batch(out, LINE)

    ordered = keys.select("key").repartitionByRange("key").sortWithinPartitions("key")
    found = ordered.mapInArrow(hits, "key string, folder string, segment string, offset long, length long")
    return found.repartition("segment", "offset").sortWithinPartitions("folder", "segment", "offset", "key").mapInArrow(lines, LINE)


def _lines(data: bytes) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n")[:-1]]


def find(segments: DataFrame, urls: list[str]) -> dict[str, list[list]]:
    """``look_up`` for a few URLs: the index lines of each."""
    rows = segments.sparkSession.createDataFrame([(url_key(u),) for u in urls], "key string").distinct()
    held: dict[str, list[list]] = {}
    for r in look_up(rows, segments).toLocalIterator():
        held.setdefault(r["key"], []).append(list(r))
    return {u: held.get(url_key(u), []) for u in urls}


def fetch(folder: str, file: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by a range read."""
    system, base = pafs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{base}/{file}") as f:
        return parse_record(gzip.decompress(f.read_at(length, offset)))


def read(lines: DataFrame) -> DataFrame:
    """The records of index lines (RECORD), fetched in order of their place; a large file is dealt to several tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, handle = None, None
        for batch in batches:
            out = []
            for folder, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (folder, file) != name:
                    if handle:
                        handle.close()
                    system, base = pafs.FileSystem.from_uri(folder)
                    name, handle = (folder, file), system.open_input_file(f"{base}/{file}")
                out.append(_row(*parse_record(gzip.decompress(handle.read_at(length, offset)))))
            yield _batch(out, RECORD)
        if handle:
            handle.close()

    span = (F.col("offset") / SPAN).cast("long")
    order = lines.select("folder", "file", "offset", "length").repartition("file", span).sortWithinPartitions("file", "offset")
    return order.mapInArrow(work, RECORD)
