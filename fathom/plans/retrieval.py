"""Retrieval pipelines over batches of queries: search, fuse, rerank, cut, and only then join the content."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.models import FAILED, Embedder, Scorer, Writer, dense_text
from fathom.functions.render import candidate_lines
from fathom.functions.text import actor_name, cited_ids, technique, technique_ids
from fathom.operators import blocks
from fathom.operators import retrieval as R
from fathom.operators.blocks import Blocks
from fathom.plans.settings import Settings, alpha, get_settings
from fathom.sinks import materialized

Search = Callable[[DataFrame, int], DataFrame]


def of_sources(df: DataFrame, sources: str | list[str] | None, column: str = "source") -> DataFrame:
    """Rows of one or several sources; none, an empty text or an empty list are no filter."""
    wanted = [sources] if isinstance(sources, str) and sources else list(sources or [])
    return df.where(F.col(column).isin(wanted)) if wanted else df


@dataclass(frozen=True)
class Index:
    """chunks: chunk_id, source, content (and attack_id, pulse_id, vector if there are any), with the BM25 tables. stored: the
    same postings in blocks; where they are there, a search over all sources reads them instead of ``weights``."""

    chunks: DataFrame
    terms: DataFrame
    stats: DataFrame
    weights: DataFrame
    stored: Blocks | None = None
    #: Tasks that the postings are dealt to, told by their number; null leaves it to Spark, which goes by their bytes.
    parts: int | None = None


#: Postings that one task multiplies: each meets all queries of its term, so the products are many times their bytes.
POSTINGS = 1 << 17


def build_index(chunks: DataFrame, asked: DataFrame | None = None) -> Index:
    """An index over all terms, or over those of the queries in ``asked`` (query_id, text). Chunks are tokenized once.

    Counts, terms and vocabulary are written tables, of which Spark knows the size: it broadcasts those that are small."""
    only = None if asked is None else materialized(R.asked_terms(asked).select("term").distinct(), "asked")
    counts = materialized(R.term_counts(chunks, only=only), "counts")
    terms, stats = (materialized(df, name) for df, name in zip(R.bm25_tables(counts), ("terms", "stats"), strict=True))
    parts = max(chunks.sparkSession.sparkContext.defaultParallelism, -(-counts.count() // POSTINGS))
    return Index(chunks, terms, stats, R.postings(counts, terms, stats), parts=parts)


def sparse_search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank). Queries without a known term have no rows."""
    if index.stored is not None:
        return blocks.search(index.stored, queries, k).results
    terms = materialized(R.query_terms(queries, index.terms), "query-terms")
    return R.ranked(R.sparse_scores(terms, index.weights, parts=index.parts), k)


def dense_search(index: Index, queries: DataFrame, k: int, embed: Embedder | None = None) -> DataFrame:
    """The same by cosine; queries carry ``vector``, or a text that is embedded here."""
    qs = queries if "vector" in queries.columns else queries.withColumn("vector", embed(F.col("dense_text" if "dense_text" in queries.columns else "text")))
    return R.ranked(R.dense_scores(qs, index.chunks, k), k)


@dataclass(frozen=True)
class Pipeline:
    index: Index
    settings: Settings
    embed: Embedder | None = None
    score: Scorer | None = None
    write: Writer | None = None

    def run(self, queries: DataFrame, k: int | None = None, sources: str | list[str] | None = None) -> DataFrame:
        """queries: query_id, text. Result: query_id, chunk_id, score, rank, retriever and the chunk's columns."""
        s, k = self.settings, k or self.settings.retrieval_top_k
        fetch = max(k, s.reranker_candidates) if self.score else k
        index = replace(self.index, chunks=of_sources(self.index.chunks, sources))
        if sources:
            index = replace(index, stored=None, weights=index.weights.join(index.chunks.select("chunk_id"), "chunk_id", "left_semi"))
        if self.write is not None:
            queries = queries.withColumn("dense_text", dense_text(F.col("text"), self.write, s.hyde_min_tokens, s.hyde_max_chars))
        if s.hybrid_alpha >= 1:
            found = dense_search(index, queries, fetch, self.embed).withColumn("retriever", F.lit("dense"))
        else:
            deep = fetch * max(s.fetch_multiplier, 1)
            lists = [(dense_search(index, queries, deep, self.embed), s.hybrid_alpha)] if s.hybrid_alpha > 0 else []
            lists.append((sparse_search(index, queries, deep), 1 - s.hybrid_alpha))
            found = R.fuse(lists, s.rrf_k).where(F.col("rank") < fetch).withColumn("retriever", F.lit("rrf"))
        if self.score:
            pairs = found.join(queries.select("query_id", "text"), "query_id").join(index.chunks.select("chunk_id", "content"), "chunk_id")
            found = R.rerank(pairs, self.score(F.col("text"), F.col("content"))).drop("text", "content")
        found = found.where(F.col("rank") < k).select("query_id", "chunk_id", "score", "rank", "retriever")
        return found.join(index.chunks.drop("vector"), "chunk_id")


def build(index: Index, config: str = "hybrid", settings: Settings | None = None, embed: Embedder | None = None, score: Scorer | None = None, write: Writer | None = None) -> Pipeline:
    """A pipeline by configuration name (dense, hybrid, hybrid+hyde): its weight, and a rewriter only where asked for."""
    s = replace(settings or get_settings(), hybrid_alpha=alpha(config))
    return Pipeline(index, s, embed, score if s.reranker_enabled else None, write if config.endswith("hyde") else None)


def answer(queries: DataFrame, results: DataFrame, write: Writer, prompt: str) -> DataFrame:
    """(query_id, text, answer, cited): answers of a model to question and candidates; FAILED where it gave none."""
    rows = queries.join(candidate_lines(results), "query_id", "left")
    asked = F.concat(F.lit(prompt + "\n\n"), F.coalesce("candidates", F.lit("")), F.lit("\n\n"), F.col("text"))
    made = F.coalesce(F.nullif(F.trim(write(asked)), F.lit("")), F.lit(FAILED))
    return rows.select("query_id", "text", made.alias("answer")).withColumn("cited", cited_ids(F.col("answer")))


def annotate(queries: DataFrame, results: DataFrame, write: Writer, prompt: str, k: int = 10) -> DataFrame:
    """(query_id, techniques): one chunk a technique goes to the model, and the ids in its answer count."""
    rows = results.withColumn("technique", technique(F.coalesce("attack_id", F.lit(""))))
    best = R.best_per_group(rows, "technique").where(F.col("rank") < k)
    return answer(queries, best, write, prompt).select("query_id", technique_ids(F.col("answer")).alias("techniques"))


def attribute(queries: DataFrame, results: DataFrame, write: Writer, prompt: str) -> DataFrame:
    """(query_id, actor): the name in the model's answer, empty for none."""
    got = answer(queries, results, write, prompt)
    return got.select("query_id", F.when(F.col("answer") == FAILED, "").otherwise(actor_name(F.col("answer"))).alias("actor"))


def answered(rows: DataFrame, column: str = "answer") -> DataFrame:
    """Without failed or blank answers."""
    c: Column = F.coalesce(F.trim(column), F.lit(""))
    return rows.where((c != "") & (c != FAILED))
