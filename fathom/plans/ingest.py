"""Ingestion: documents to chunks, chunks to tables; a run again changes only what has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.text import point_id
from fathom.operators import blocks
from fathom.operators.blocks import Blocks
from fathom.operators.chunking import chunk
from fathom.operators.layout import spread
from fathom.plans.retrieval import Index
from fathom.sinks import materialized, read_model, store, versioned, write_chunks
from fathom.sources import files


def seed(docs: DataFrame, path: str, strategy: str | None = None, limit: int | None = None) -> dict[str, int]:
    """Documents to JSON lines of chunks; the limit counts documents by id. How many of each there were."""
    docs = docs if limit is None else docs.orderBy("id").limit(limit)
    write_chunks(chunk(docs, strategy), path)
    rows = docs.sparkSession.read.schema(files.CHUNK).json(path)
    n = rows.agg(F.count_distinct("parent_doc_id").alias("documents"), F.count("*").alias("chunks")).first()
    return n.asDict()


def load(spark: SparkSession, paths: dict[str, str], table: str) -> dict[str, int]:
    """Chunk files by source into a versioned table keyed by point id; a missing file counts 0. A chunk replaces what the table
    has under its id; of several in the files the last counts, files in order of their time of change, then their path."""
    out = {}
    for source, path in paths.items():
        try:
            rows = files.chunks(spark, path)[0].withColumn("seq", files.place())
        except Exception as e:  # Spark's error for a missing path
            if "PATH_NOT_FOUND" not in str(e):
                raise
            out[source] = 0
            continue
        rows = rows.withColumn("point_id", point_id(F.col("id"))).withColumnRenamed("id", "chunk_id")
        rows = materialized(rows, "loaded")
        out[source] = rows.count()
        versioned.upsert(rows, versioned.location(spark, table), ["point_id"])
    return out


def changed_since(docs: DataFrame, mark: str | None) -> DataFrame:
    """Documents whose source's own time of change is after a mark (both ISO 8601, compared as text); those without one stay."""
    if mark is None:
        return docs
    changed = F.coalesce(*[F.nullif(F.get_json_object("metadata", f"$.{k}"), F.lit("")) for k in ("last_modified", "updated", "last_seen")])
    return docs.where(changed.isNull() | (changed > mark))


def status_counts(log: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(status, n, chunks) of a run's log, and of those before it."""
    rows = log.select("status", "chunks") if before is None else log.select("status", "chunks").unionByName(before.select("status", "chunks"))
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


def model(chunks: DataFrame, path: str, refit: bool = False) -> Blocks:
    """The stored sparse index of ``chunks`` at ``path``, written anew. Its terms' weights are those of the model that is there, unless asked to fit anew."""
    spark, known = chunks.sparkSession, None
    if not refit:
        try:
            known = tuple(materialized(df, "model") for df in read_model(spark, path))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return blocks.build(chunks, path, model=known)


def index_table(spark: SparkSession, table: str, path: str, refit: bool = False) -> None:
    """Makes a stored table ready to be searched: its sparse index, and the vectors of its chunks, in a folder for the table's version.

    It runs once after loading; a search then tokenizes and embeds its questions alone."""
    from fathom.functions.models import hashed_vector

    place = versioned.location(spark, table)
    at, chunks = versioned.version(spark, place), versioned.read(spark, place)
    found = model(chunks, path, refit)
    vectors = spread(chunks.select("chunk_id", "content")).select("chunk_id", hashed_vector()(F.col("content")).alias("vector"))
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    store.delete(spark, f"{path}/indexed")
    store.put_new(spark, f"{path}/indexed", f"{at.number} {found.key}")


def stored_index(spark: SparkSession, table: str, path: str) -> Index:
    """The index over a stored table: ids of techniques and pulses from its metadata, stored vectors, stored postings.

    A table that has changed since ``index_table``, or was never given to it, is indexed here first."""
    place = versioned.location(spark, table)
    at = versioned.version(spark, place)
    if at is None:
        raise FileNotFoundError(f"nothing has been loaded into {table}")
    there = all(store.exists(spark, f"{path}/{name}") for name in ("indexed", "postings"))
    if not there or store.read_text(spark, f"{path}/indexed").split()[0] != str(at.number):
        index_table(spark, table, path)
    stored, vectors = blocks.load(spark, path), spark.read.parquet(f"{path}/vectors")
    chunks = versioned.read(spark, place, at.number)
    chunks = chunks.withColumn("attack_id", F.get_json_object("metadata", "$.attack_id")).withColumn("pulse_id", F.get_json_object("metadata", "$.pulse_id"))
    each = F.explode(F.arrays_zip("keys", "weights"))
    rows = stored.blocks.select("term", each.alias("r")).join(stored.terms.select("term", "idf"), "term")
    weights = rows.select("term", F.col("r.keys").alias("chunk_id"), (F.col("idf") * F.col("r.weights")).alias("weight"))
    return Index(chunks.join(vectors, "chunk_id"), stored.terms, stored.stats, weights, stored)
