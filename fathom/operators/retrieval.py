"""Sparse, dense and fused ranking of chunks for batches of queries, as plans over (query_id, chunk_id)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fathom.functions.tokens import tokenize, tokenized
from fathom.operators.layout import spread, spread_by

K1, B = 1.5, 0.75
RRF_K = 60


#: The term of the row that stands for a document as a whole; no token is empty.
WHOLE = ""


def term_counts(docs: DataFrame, key: str = "chunk_id", text: str = "content", only: DataFrame | None = None) -> DataFrame:
    """(key, dl, term, tf): how often each term occurs, and how many tokens the document has; one row more for each
    document, its term WHOLE, so that one pass gives lengths too. ``only`` (term) keeps the rows of some terms, as
    queries that name theirs need no others. Texts are dealt by their key, so that the terms, which are more bytes, are
    counted where they are made."""
    rows = tokenized(spread(docs.select(key, text)), text, "t", lambda df: spread_by(df, key))
    rows = rows.select(key, F.size("t").alias("dl"), F.explode(F.array_append("t", F.lit(WHOLE))).alias("term"))
    if only is not None:
        whole = only.sparkSession.range(1).select(F.lit(WHOLE).alias("term"))  # of a known size, so that Spark sends a small set to all tasks
        rows = rows.join(only.select("term").distinct().unionByName(whole), "term", "left_semi")
    return rows.groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))


def frequencies(docs: DataFrame, text: str = "content") -> DataFrame:
    """(term, df): in how many documents each term occurs; rows combine before the shuffle, which moves the vocabulary alone."""
    return tokenized(spread(docs.select(text)), text, "t").select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def bm25_stats(docs: DataFrame, text: str = "content") -> DataFrame:
    """One row: num_docs and avgdl."""
    return length_stats(tokenized(spread(docs.select(text)), text, "t").select(F.size("t").alias("dl")))


def length_stats(lengths: DataFrame) -> DataFrame:
    """One row: num_docs and avgdl of (dl)."""
    return lengths.agg(F.count("*").alias("num_docs"), F.coalesce(F.sum("dl") / F.count("*"), F.lit(0.0)).alias("avgdl"))


def bm25_terms(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf) of (term, df); ``stats`` is one row with num_docs."""
    idf = F.log((F.col("num_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return df.crossJoin(F.broadcast(stats.select("num_docs"))).select("term", "df", idf.alias("idf"))


def bm25_tables(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(terms, stats) of term counts, which are used several times: a written table, not a plan."""
    stats = length_stats(counts.where(F.col("term") == WHOLE))
    return bm25_terms(counts.where(F.col("term") != WHOLE).groupBy("term").agg(F.count("*").alias("df")), stats), stats


#: Terms that are sent to all tasks, at most.
SENT = 1 << 18


def weighed(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows of ``counts`` with their terms' idf; terms that are not known have none. Both are written tables.

    Most rows are those of frequent terms, which are few: a term that has one in SENT of all rows or more goes to all tasks. Only the
    rows of the rest, none of them frequent, are shuffled."""
    rows, known = counts.where(F.col("term") != WHOLE), terms.select("term", "idf")
    n, total = terms.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
    if n <= SENT:
        return rows.join(F.broadcast(known), "term")
    frequent = F.broadcast(terms.where(F.col("df") >= max(2, -(-total // SENT))).select("term", "idf"))
    rest = rows.join(frequent, "term", "left_anti").join(known.join(frequent, "term", "left_anti"), "term")
    return rows.join(frequent, "term").unionByName(rest)


def saturated(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a term that occurs ``tf`` times in ``dl`` tokens weighs, before its idf. avgdl is 1 at least."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def postings(counts: DataFrame, terms: DataFrame, stats: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(term, key, weight): the document side of the sparse product."""
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.greatest("avgdl", F.lit(1.0)))
    rows = weighed(counts, terms).crossJoin(F.broadcast(stats.select("avgdl")))
    return rows.select("term", key, (F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("weight"))


def asked_terms(queries: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """(query, term): the distinct terms of each query."""
    return tokenized(queries.select(key, text), text, "t").select(key, F.explode(F.array_distinct("t")).alias("term"))


def query_terms(queries: DataFrame, terms: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """(query, term, idf) of the distinct known terms."""
    return asked_terms(queries, key, text).join(terms.select("term", "idf"), "term")


#: Decimal places to which scores are compared: sums of one document's parts differ beyond them with the order of the parts.
PLACES, FUSED_PLACES = 9, 12


def ranked(scores: DataFrame, k: int | None = None, query: str = "query_id", key: str = "chunk_id", ties: list[Column] | None = None, places: int = PLACES) -> DataFrame:
    """``scores`` with 0-based ``rank``; scores equal to ``places`` are ties, which go to the lesser key unless told otherwise.

    The limit is on the bare row number, by which Spark cuts each task's rows before the shuffle."""
    order = Window.partitionBy(query).orderBy(F.desc(F.rint(F.col("score") * 10**places)), *(ties or []), F.col(key))
    out = scores.withColumn("rank", F.row_number().over(order))
    return (out if k is None else out.where(F.col("rank") <= k)).withColumn("rank", F.col("rank") - 1)


def sparse_scores(queries: DataFrame, weights: DataFrame, query: str = "query_id", key: str = "chunk_id", parts: int | None = None) -> DataFrame:
    """Products of query and document weights, summed; a document without a common term has no row.

    Postings are dealt by document, so that a pair's parts meet where they are made and only the postings are shuffled; a
    number of ``parts`` is kept, while Spark would join small ones by the postings' bytes, which are few beside the products'."""
    rows = (weights.repartition(key) if parts is None else weights.repartition(parts, key)).join(queries, "term")
    return rows.groupBy(query, key).agg(F.sum(F.col("idf") * F.col("weight")).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Query vectors up to so many are sent to every task and multiplied there.
QUERY_BLOCK = 4096
#: Scores that a task holds at once, whatever the number of queries.
TOGETHER = 1 << 20


def dense_scores(queries: DataFrame, vectors: DataFrame, k: int, query: str = "query_id", key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """The exact k best of each query by cosine, candidates pruned to k within every batch before they are ranked.

    The queries are a stated set. Up to QUERY_BLOCK of them, which is checked, go to the tasks as a matrix for each length,
    and vectors are read where they are; more meet the vectors as a grid of blocks and parts (``neighbours.met``), without
    passing the driver. Zero vectors score 0; vectors of another length than the query's are no candidates. A query
    without a vector has no results."""
    qs = queries.select(F.col(query).alias("q"), F.col(vector).alias("v")).where("v IS NOT NULL")
    first = qs.limit(QUERY_BLOCK + 1).collect()
    if len(first) > QUERY_BLOCK:
        return _dense_grid(qs, vectors, k, query, key, vector)
    kinds = f"`{query}` {queries.schema[query].dataType.simpleString()}, `{key}` {vectors.schema[key].dataType.simpleString()}, score double"
    kind = to_arrow_type(queries.schema[query].dataType)

    def unit(m: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, size, out=np.zeros_like(m), where=size > 0)

    def block(rows: list) -> DataFrame:
        ids = [r["q"] for r in rows]
        matrix = unit(np.array([r["v"] for r in rows], np.float64))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(1)
                fits = np.flatnonzero(np.array([x is not None and x == matrix.shape[1] for x in lists.value_lengths().to_pylist()], bool))
                if not len(fits):
                    continue
                kept_ = lists.take(pa.array(fits))
                own = unit(kept_.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), -1))
                names = batch.column(0).take(pa.array(fits))
                most = min(k, len(fits))
                step = max(1, TOGETHER // len(fits))
                for low in range(0, len(ids), step):
                    found = own @ matrix[low : low + step].T
                    least = np.partition(found, len(fits) - most, axis=0)[len(fits) - most]
                    q, rows_ = np.nonzero((found >= least).T)  # ties with the last stay, to be ranked by key
                    yield pa.RecordBatch.from_arrays([pa.array([ids[low + i] for i in q.tolist()], kind), names.take(pa.array(rows_)), pa.array(found[rows_, q])], [query, key, "score"])

        return vectors.select(key, vector).mapInArrow(work, kinds)

    by_length: dict[int, list] = {}
    for r in first:
        by_length.setdefault(len(r["v"]), []).append(r)
    parts = [block(rows) for n, rows in sorted(by_length.items()) if n]
    return reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], kinds)


def _dense_grid(qs: DataFrame, vectors: DataFrame, k: int, query: str, key: str, vector: str) -> DataFrame:
    """The scores of more queries than one task is to hold; vectors go once to each block of queries of their length."""
    from fathom.operators.neighbours import BLOCK, PART, met

    blocks = -(-qs.count() // BLOCK)
    parts = max(1, -(-vectors.count() // PART))
    part = lambda name, of: F.pmod(F.xxhash64(name), F.lit(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    none, all_ = F.lit(0.0), F.lit(float("inf"))
    left = qs.where("size(v) > 0").select(F.col("q").alias(query), "v", F.size("v").alias("cell"), part("q", blocks).alias("block"), none.alias("at"), all_.alias("within"))
    right = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(key, F.col(vector).alias("v"), F.size(vector).alias("cell"), part(key, parts).alias("part"), none.alias("residual"))
    return met(left.withColumn("part", each(parts)), right.withColumn("block", each(blocks)), k, query, key)


def fuse(lists: list[tuple[DataFrame, float]], k: int = RRF_K, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """Weighted reciprocal-rank fusion of ranked lists: (query, key, score, rank). Lists of weight 0 take no part.

    Ties go to the earlier list, then the better rank in it, then the lesser key."""
    weights = [w for _, w in lists]
    if not lists or any(w < 0 for w in weights) or sum(weights) <= 0:
        raise ValueError("weights must not be negative and must have a positive sum")
    used = [(n, df, w) for n, (df, w) in enumerate(lists) if w > 0]
    rows = [df.select(query, key, (F.lit(float(w)) / (k + F.col("rank") + 1)).alias("part"), F.struct(F.lit(n).alias("list"), F.col("rank").cast("long").alias("rank")).alias("seen")) for n, df, w in used]
    all_ = rows[0]
    for r in rows[1:]:
        all_ = all_.unionByName(r)
    total = all_.groupBy(query, key).agg(F.sum("part").alias("score"), F.min("seen").alias("seen"))
    return ranked(total, None, query, key, [F.col("seen.list"), F.col("seen.rank")], FUSED_PLACES).drop("seen")


def overlap_score(query: Column, content: Column) -> Column:
    """A stand-in for a cross-encoder: the share of the query's distinct tokens that the content has."""
    q = F.array_distinct(tokenize(query))
    return F.coalesce(F.size(F.array_intersect(q, tokenize(content))) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))


def rerank(results: DataFrame, score: Column, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """Results with a new score and rank; ties keep their former order."""
    return ranked(results.withColumn("_before", F.col("rank")).withColumn("score", score), None, query, key, [F.col("_before")]).drop("_before")


def best_per_group(results: DataFrame, group: str, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """The highest result of each group of a query, the first of equals; blanks have no group. Ranked anew; ties by the group's first rank."""
    rows = results.where(F.coalesce(F.trim(group), F.lit("")) != "")
    within = Window.partitionBy(query, group)
    rows = rows.withColumn("_first", F.min("rank").over(within)).withColumn("_n", F.row_number().over(within.orderBy(F.desc("score"), "rank")))
    return ranked(rows.where("_n = 1").drop("_n"), None, query, key, [F.col("_first")]).drop("_first")
