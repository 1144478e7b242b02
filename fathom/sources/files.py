"""File sources: chunk records, query sets, tables of text and gold, logs, reports, web pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions.text import document_id, resolve_url, safe_filename, technique_ids, unescaped
from fathom.operators.keyed import first_by_key, last_by_key, zipped
from fathom.operators.sections import keep, merge_forward

CHUNK = "id string, parent_doc_id string, source string, content string, chunk_index int, metadata string, retrieved_at string"
QUERY = "query_id string, query string, category string, gold_attack_ids array<string>, gold_sources array<string>, expected_chunk_ids array<string>, reference_answer string, gold_actor string, gold_pulse_id string, gold_malware string, notes string"
CATEGORIES = ("precise", "semantic", "fuzzy")


def lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed ones are kept apart in _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def chunks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, skipped): records that lack a required key, or whose time does not parse, are skipped."""
    rows = lines(spark, path, CHUNK).withColumn("at", F.try_to_timestamp("retrieved_at").cast("timestamp_ntz"))
    whole = F.col("_corrupt").isNull() & F.col("at").isNotNull()
    for c in ("id", "parent_doc_id", "source", "content", "chunk_index"):
        whole = whole & F.col(c).isNotNull()
    good = rows.where(whole).drop("_corrupt", "retrieved_at").withColumnRenamed("at", "retrieved_at")
    return good, rows.where(~whole)


def place() -> Column:
    """Where a row stands among the files read: later files, then later parts of a file, then later lines are greater."""
    return F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())


def pulse_ids(value: Column) -> Column:
    """Null, a string or a JSON list, read as a string, to a list without empty entries."""
    many = F.when(F.startswith(F.ltrim(value), F.lit("[")), F.from_json(value, "array<string>")).otherwise(F.array(value))
    return F.filter(F.coalesce(many, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")


def query_set(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """A query set with lists for missing lists; ``strict`` takes only the three first categories, any other is an error."""
    rows = lines(spark, path, QUERY).where("_corrupt IS NULL").drop("_corrupt")
    if strict:
        known = F.col("category").isin(*CATEGORIES)
        rows = rows.where(F.when(known, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown category "), F.coalesce("category", F.lit("null"))))))
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("gold_attack_ids", "gold_sources", "expected_chunk_ids")}
    return rows.withColumns({**lists, "gold_pulse_ids": pulse_ids(F.col("gold_pulse_id"))}).drop("gold_pulse_id")


def labelled_texts(rows: DataFrame, text: str, ids: str, most: int | None = None, position: str | None = None) -> DataFrame:
    """Rows with text and technique ids found in ``ids``; without either they fall out. A limit takes the first by ``position``."""
    out = rows.withColumn("gold", technique_ids(F.col(ids))).where((F.coalesce(F.trim(text), F.lit("")) != "") & (F.size("gold") > 0))
    return out if most is None else out.orderBy(position or text).limit(most)


def numbered(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(position, ``name``): the lines of text files with their numbers; several files count on in order of their paths.

    Lines are numbered within their files, and each file begins where the lines of those before it end; only the table of
    files, a row for each, is put in order as a whole."""
    files_ = spark.read.text(path, wholetext=True).select("value", "_metadata.file_path")
    lines_ = F.when(F.col("value") == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n"))
    files_ = files_.select("file_path", lines_.alias("lines"))
    before = Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    starts = files_.select("file_path", F.coalesce(F.sum(F.size("lines")).over(before), F.lit(0)).cast("long").alias("start"))
    rows = files_.select("file_path", F.posexplode("lines").alias("line", name)).join(starts, "file_path")
    return rows.select((F.col("start") + F.col("line")).alias("position"), name)


def paired(spark: SparkSession, texts: str, gold: str) -> DataFrame:
    """Two files joined line by line."""
    return zipped(numbered(spark, texts, "text"), numbered(spark, gold, "gold"))


def platform_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with Description, GT and Platform."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path).select(F.col("Description").alias("text"), F.col("GT").alias("gold_text"), F.col("Platform").alias("platform"))
    return labelled_texts(rows, "text", "gold_text")


def on_platform(rows: DataFrame, platform: str | None) -> DataFrame:
    return rows if platform is None else rows.where(F.lower("platform") == platform.lower())


def checkpoint(spark: SparkSession, path: str, key: str = "pulse_id") -> DataFrame:
    """The last record of each key of an append-only log; malformed lines do not count."""
    rows = lines(spark, path, f"{key} string, status string, chunks int, error string").where(f"_corrupt IS NULL AND {key} IS NOT NULL")
    return last_by_key(rows.withColumn("_n", place()), [key], "_n").drop("_n", "_corrupt")


def distinct_keys(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.trim(column).alias(column)).where(f"{column} <> ''").distinct().orderBy(column)


def domain_list(spark: SparkSession, path: str, more: list[str] | None = None) -> DataFrame:
    """Given domains, then a file's lines without blanks and # comments: distinct, in order of first mention."""
    given = spark.createDataFrame([(n, d) for n, d in enumerate(more or [])], "position long, domain string")
    rows = numbered(spark, path, "domain").withColumn("position", F.col("position") + len(more or []))
    rows = given.unionByName(rows).select("position", F.trim("domain").alias("domain")).where("domain <> '' AND NOT startswith(domain, '#')")
    return rows.groupBy("domain").agg(F.min("position").alias("position")).orderBy("position")


def actor_table(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of lists to (name, others, position). Pickles are not read."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,array<string>>"))).alias("position", "e"))
    return pairs.select(F.col("e.key").alias("name"), F.col("e.value").alias("others"), "position")


def newest_file(spark: SparkSession, path: str) -> DataFrame:
    """The whole text of the file changed last."""
    rows = spark.read.text(path, wholetext=True).select("value", "_metadata.file_path", "_metadata.file_modification_time")
    return rows.orderBy(F.desc("file_modification_time"), F.desc("file_path")).limit(1)


#: A parser takes a report's bytes and returns (title, page, text) sections in order.
Parser = Callable[[bytes], list[tuple[str, int, str]]]


def reports(spark: SparkSession, folder: str, parser: Parser, glob: str = "*.pdf") -> DataFrame:
    """Report files below a folder to section documents. A file that the parser fails on has no sections."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path", "content")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    parts = parser(bytes(content))
                except Exception:  # noqa: BLE001  any parser, any fault: the file is skipped
                    parts = []
                out += [(path, n, t, p, x) for n, (t, p, x) in enumerate(parts)]
            yield pd.DataFrame(out, columns=["doc_id", "position", "section_title", "page", "text"])

    rows = files.mapInPandas(work, "doc_id string, position int, section_title string, page int, text string")
    rows = merge_forward(rows.where(keep(F.col("text"), F.col("section_title"))))
    key = F.concat_ws(":", "doc_id", F.col("position").cast("string"))
    name = F.substring_index("doc_id", "/", -1)
    metadata = F.to_json(F.struct(F.col("doc_id").alias("pdf_path"), name.alias("filename"), F.substring(F.sha2(name, 256), 1, 16).alias("file_id"), "section_title", "page", F.col("position").alias("section_index")))
    return rows.select(document_id("pdf", key).alias("id"), F.lit("pdf").alias("source"), F.col("text").alias("content"), metadata.alias("metadata"))


#: An anchor up to the end of its target, which is in double or single quotes or bare; and what stands before the target.
ANCHOR_HEAD = r"(?i)^<a\s(?:[^>]*?\s)?href\s*=\s*"
ANCHOR = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""


def links(pages: DataFrame, html: str = "html", url: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """(url, position, link): the targets of all anchors, without character references, made absolute.

    ``keep`` names columns of the pages to stand beside them: several pages may have one URL."""
    found = F.regexp_extract_all(html, F.lit(ANCHOR), 0)
    rows = pages.select(url, *keep, F.posexplode(found).alias("position", "tag"))
    href = F.regexp_replace(F.regexp_replace("tag", ANCHOR_HEAD, ""), "^[\"']|[\"']$", "")
    return rows.select(url, *keep, "position", unescaped(href).alias("href")).select(url, *keep, "position", resolve_url(F.col(url), F.col("href")).alias("link"))


def report_links(found: DataFrame, kind: str) -> DataFrame:
    """Links to reports: ``curated`` any PDF, ``files`` PDFs below a site's default files, ``advisory`` advisory pages."""
    link = F.col("link")
    pdf = F.lower(link).rlike(r"\.pdf$")
    test = {"curated": pdf, "files": pdf & F.contains(link, F.lit("/sites/default/files/")), "advisory": link.rlike(r"(?i)/cybersecurity-advisories/aa\d")}[kind]
    return found.where(test)


def first_links(lists: list[DataFrame], most: int | None = None) -> DataFrame:
    """Several link tables (position, link) in order, each link once where it came first, with a file name; at most ``most``."""
    rows = None
    for n, df in enumerate(lists):
        part = df.select(F.lit(n).alias("list"), "position", "link")
        rows = part if rows is None else rows.unionByName(part)
    one = first_by_key(rows, ["link"], "list", "position").withColumn("filename", safe_filename(F.col("link")))
    one = one.orderBy("list", "position", "link")
    return one if most is None else one.limit(most)


def newest_where(files_: DataFrame, holds: Column) -> DataFrame:
    """Of whole-text files (value, file_path, file_modification_time) the newest whose content passes a test."""
    return files_.where(holds).orderBy(F.desc("file_modification_time"), F.desc("file_path")).limit(1)


def saved_metrics(spark: SparkSession, path: str, required: tuple[str, ...] = ("config", "category", "k", "hit_rate", "mrr")) -> DataFrame:
    """A saved evaluation; one that lacks a required key is an error."""
    rows = spark.read.option("multiLine", True).json(path)
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return rows


def pooled(sources: list[DataFrame], n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """n rows of several sources together, drawn by a seeded hash of their keys: the same rows however they lie."""
    rows = sources[0]
    for df in sources[1:]:
        rows = rows.unionByName(df)
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


#: Fixed value: bytes of a report beyond which it is not kept.
MOST_BYTES = 50 * 1024 * 1024


def usable_report(content_type: str, url: str, size: int) -> bool:
    """Whether an answer is a report to keep: it says so, or its URL does, and it is not too large."""
    return ("pdf" in content_type or url.lower().endswith(".pdf")) and size <= MOST_BYTES


def download(url: str, folder: str, name: str, dry_run: bool = False, timeout: float = 30.0) -> bool:
    """One report into a folder, by any file system; what is there already is not fetched again. Whether it is there, or would be."""
    import urllib.request

    import pyarrow.fs as pafs

    system, base = pafs.FileSystem.from_uri(folder)
    at = f"{base}/{name}"
    if dry_run or system.get_file_info(at).type == pafs.FileType.File:
        return True
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
            data = answer.read(MOST_BYTES + 1)
            if not usable_report(answer.headers.get("content-type", ""), url, len(data)):
                return False
    except (OSError, ValueError):
        return False
    system.create_dir(base, recursive=True)
    with system.open_output_stream(at) as out:
        out.write(data)
    return True
