"""Documents to chunks: structured, fixed windows, or whole sentences with overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import chunk_id, chunk_strategy, clean, strip
from fathom.operators.layout import spread

CHARS = 4
TARGET, OVERLAP = 600, 80


def steps(text: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """The text cut where fixed windows start."""
    if overlap >= target:
        raise ValueError("overlap must be less than target")
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{(target - overlap) * CHARS}}}+"), 0)


def fixed_chunks(parts: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """Windows of ``target`` tokens (of CHARS characters), each starting ``overlap`` before the last one's end, joined from a text's steps."""
    reach = -(-target // (target - overlap))
    return F.transform(parts, lambda _, i: F.substring(F.array_join(F.slice(parts, i + 1, reach), ""), 1, target * CHARS))


def sentences(text: Column) -> Column:
    return F.split(strip(text), r"(?<=[.!?])\s+")


def sentence_ranges(parts: Column, target: int, overlap: int) -> Column:
    """(first, last) of each chunk, counted from 1: a fold over the sentences' lengths that carries only ranges.

    A chunk is closed where the next sentence would pass ``target``; the next chunk begins with the longest run of
    its last sentences that is no longer than ``overlap``."""
    empty = F.array().cast("array<struct<first:int,last:int>>")
    start = F.struct(empty.alias("done"), F.lit(1).alias("first"), F.lit(0).alias("size"), F.lit(0).alias("i"))

    def tail(first: Column, last: Column) -> Column:
        """(how many last sentences fit into the overlap, their length)."""
        back = F.reverse(F.slice(parts, first, last - first + 1))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(True).alias("open"))
        return F.aggregate(
            back, zero,
            lambda a, s: F.struct(
                F.when(a["open"] & (a["size"] + F.length(s) <= overlap), a["n"] + 1).otherwise(a["n"]).alias("n"),
                F.when(a["open"] & (a["size"] + F.length(s) <= overlap), a["size"] + F.length(s)).otherwise(a["size"]).alias("size"),
                (a["open"] & (a["size"] + F.length(s) <= overlap)).alias("open"),
            ),
        )

    def step(a: Column, s: Column) -> Column:
        i = a["i"] + 1
        close = (a["size"] + F.length(s) > target) & (i > a["first"])
        t = tail(a["first"], a["i"])
        closed = F.array_append(a["done"], F.struct(a["first"].alias("first"), a["i"].alias("last")))
        return F.when(
            close, F.struct(closed.alias("done"), (i - t["n"]).alias("first"), (t["size"] + F.length(s)).alias("size"), i.alias("i"))
        ).otherwise(F.struct(a["done"].alias("done"), a["first"].alias("first"), (a["size"] + F.length(s)).alias("size"), i.alias("i")))

    return F.aggregate(parts, start, step, lambda a: F.array_append(a["done"], F.struct(a["first"].alias("first"), a["i"].alias("last"))))


def semantic_chunks(parts: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """Runs of whole sentences; ``parts`` are a text's sentences."""
    ranges = sentence_ranges(parts, target * CHARS, overlap * CHARS)
    return F.transform(ranges, lambda r: F.array_join(F.slice(parts, r["first"], r["last"] - r["first"] + 1), " "))


def chunk(docs: DataFrame, strategy: str | None = None, target: int = TARGET, overlap: int = OVERLAP, content: str = "content") -> DataFrame:
    """One row a chunk: the document's columns (``id`` as parent_doc_id), id, chunk_index and content.

    Without a strategy each row's source picks one. Blank documents have no chunks. A text is cleaned and cut in a
    projection of its own, so that the expressions over its parts read a column and take time in proportion to it."""
    text, parts = clean(F.col(content)), F.col("_parts")
    cut = {"structured": F.array(text), "fixed": steps(text, target, overlap), "semantic": sentences(text)}
    made = {"structured": parts, "fixed": fixed_chunks(parts, target, overlap), "semantic": semantic_chunks(parts, target, overlap)}
    if strategy is not None and strategy not in made:
        raise ValueError(f"unknown strategy {strategy!r}")
    by_source = lambda m: F.when(chunk_strategy(F.col("source")) == "structured", m["structured"]).otherwise(m["semantic"])
    parts_of, chunks_of = (cut[strategy], made[strategy]) if strategy else (by_source(cut), by_source(made))
    others = [c for c in docs.columns if c not in ("id", content, "parent_doc_id", "chunk_index")]
    rows = spread(docs).select(F.col("id").alias("parent_doc_id"), *others, parts_of.alias("_parts"))
    # A blank text's parts are null or hold a null alone: the test is on what was cut, not on the text, which would clean it twice.
    whole = F.when(F.try_element_at(parts, F.lit(1)).isNotNull(), chunks_of)
    rows = rows.select("parent_doc_id", *others, F.posexplode(whole).alias("chunk_index", "content"))
    return rows.select(chunk_id(F.col("parent_doc_id"), F.col("chunk_index")).alias("id"), "*")
