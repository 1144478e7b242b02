"""Prompts, messages and snippets rendered from ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import strip

CANDIDATE_CHARS = 600
NONE_FOUND = "(no candidates retrieved)"


def candidate_lines(results: DataFrame, k: int = 10, query: str = "query_id") -> DataFrame:
    """(query, candidates): the first k results as numbered lines, blanks collapsed, long content cut."""
    flat = strip(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " "))
    cut = F.when(F.length(flat) > CANDIDATE_CHARS, F.concat(F.substring(flat, 1, CANDIDATE_CHARS), F.lit("…"))).otherwise(flat)
    line = F.concat(F.lit("["), (F.col("rank") + 1).cast("string"), F.lit("] attack_id="), F.coalesce(F.nullif("attack_id", F.lit("")), F.lit("-")), F.lit(" | source="), F.col("source"), F.lit(" | "), cut)
    rows = results.where(F.col("rank") < k).groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return rows.select(query, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("candidates"))


def context_messages(queries: DataFrame, results: DataFrame, system: str, query: str = "query_id", text: str = "text") -> DataFrame:
    """(query, messages): a system message and a user message whose content is the JSON of question and ranked chunks."""
    item = F.struct("rank", F.col("chunk_id"), F.col("source"), F.round("score", 4).alias("score"), F.col("content"))
    rows = results.groupBy(query).agg(F.array_sort(F.collect_list(item)).alias("chunks"))
    rows = queries.select(query, text).join(rows, query, "left")
    body = F.to_json(F.struct(F.col(text).alias("query"), F.coalesce("chunks", F.array().cast("array<struct<rank:int,chunk_id:string,source:string,score:double,content:string>>")).alias("context")))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return rows.select(query, F.array(message("system", F.lit(system)), message("user", body)).alias("messages"))


def answer_rows(answers: DataFrame, results: DataFrame, references: DataFrame | None = None, query: str = "query_id") -> DataFrame:
    """(query, user_input, retrieved_contexts, response[, reference]) for an external judge of answers."""
    got = results.groupBy(query).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("retrieved_contexts"))
    out = answers.join(got, query, "left").select(query, F.col("text").alias("user_input"), F.coalesce("retrieved_contexts", F.array().cast("array<string>")).alias("retrieved_contexts"), F.col("answer").alias("response"))
    return out if references is None else out.join(references, query, "left")


def with_embedding_model(docs: DataFrame, model: str) -> DataFrame:
    """Documents that say which model their vectors are of."""
    return docs.withColumn("embedding_model", F.lit(model))


def query_records(per_query: DataFrame, results: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, category, hits by k, rr, target_rank, retrieved ids in order): what is kept of each query; the rank of the target is 1 / rr, null without a hit."""
    own = per_query.groupBy(query, "category").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "hit")))).alias("hits"), F.max("rr").alias("rr"))
    got = results.groupBy(query).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("retrieved"))
    return own.join(got, query, "left").withColumn("target_rank", F.when(F.col("rr") > 0, F.round(1 / F.col("rr")).cast("int")))


def relative_path(path: str, root: str) -> str:
    """A path below the root as seen from there, any other as it is."""
    inside = path.removeprefix(root.rstrip("/") + "/")
    return inside if inside != path else path


def snippet(content: Column, n: int = 120) -> Column:
    return F.translate(F.substring(content, 1, n), "\n", " ")
