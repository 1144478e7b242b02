"""Sinks: chunk records, model tables, keyed upserts, checkpoint logs and reports."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators.keyed import last_by_key, upsert

RECORD = ("id", "parent_doc_id", "source", "content", "chunk_index", "metadata", "retrieved_at")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder the cluster shares: spark.checkpoint.dir, or, for a local session as in tests, one of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("fathom.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        folder = f"file://{tempfile.mkdtemp(prefix='fathom-')}"
        spark.conf.set("fathom.shared.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read back, which ends its lineage."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``materialized`` has written and that no plan still to be run reads; others are left alone."""
    from fathom.sinks import store

    for df in tables:
        if (path := getattr(df, "kept_at", None)) is not None:
            store.delete(df.sparkSession, path)
            df.kept_at = None


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines of the record's seven columns, replacing what was there; columns that are missing are null."""
    cols = [F.col(c) if c in chunks.columns else F.lit(None).cast("string").alias(c) for c in RECORD]
    chunks.select(*cols).write.mode("overwrite").json(path)


def write_model(terms: DataFrame, stats: DataFrame, path: str) -> None:
    """The BM25 tables."""
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/stats")


def upsert_table(new: DataFrame, table: str, keys: list[str], partition: str | None = None) -> int:
    """Merge rows into a table by key, the last row winning; creates the table if it is absent. Returns how many rows came in."""
    spark, n = new.sparkSession, new.count()
    if not spark.catalog.tableExists(table):
        first = last_by_key(new, keys, "seq").drop("seq") if "seq" in new.columns else new.dropDuplicates(keys)
        writer = first.write.format("parquet")
        (writer.partitionBy(partition) if partition else writer).saveAsTable(table)
        return n
    merged = materialized(upsert(spark.table(table), new, keys))
    writer = merged.write.mode("overwrite").format("parquet")
    (writer.partitionBy(partition) if partition else writer).saveAsTable(table)
    return n


def ensure_table(spark: SparkSession, table: str, schema: str, partition: str | None = None) -> bool:
    """Creates a table with this schema if there is none; whether it did."""
    if spark.catalog.tableExists(table):
        return False
    parts = f" PARTITIONED BY ({partition})" if partition else ""
    spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet{parts}")
    return True


def point_count(table: DataFrame, source: str | None = None) -> int:
    """How many points there are, of all sources or of one."""
    return (table if source is None else table.where(F.col("source") == source)).count()


def write_query_set(queries: DataFrame, path: str) -> None:
    """A query set as JSON lines, in order of its ids."""
    queries.repartitionByRange(1, "query_id").sortWithinPartitions("query_id").write.mode("overwrite").json(path)


def cached(spark: SparkSession, path: str, make, schema: str, most: int | None = None, order: str | None = None) -> DataFrame:
    """Rows kept as JSON lines at ``path``: read if they are there, else made and written. A limit takes the first by ``order``."""
    try:
        rows = spark.read.schema(schema).json(path)
    except Exception as e:  # Spark's error for a missing path
        if "PATH_NOT_FOUND" not in str(e):
            raise
        make().write.json(path)
        rows = spark.read.schema(schema).json(path)
    return rows if most is None else rows.orderBy(order or rows.columns[0]).limit(most)


def append_log(rows: DataFrame, path: str) -> None:
    """Checkpoint rows (key, status, chunks, error) appended as JSON lines."""
    rows.write.mode("append").json(path)


def stored_content(content, cap: int = 8000):
    """What a reader of stored chunks gets of their content."""
    return F.substring(content, 1, cap)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a markdown table: a report of at most ``most`` rows."""
    rows = df.limit(most).collect()
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in rows)])


def splice(text: str, made: str, name: str) -> str:
    """``text`` with what stands between the markers of ``name`` replaced."""
    start, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    if start not in text or end not in text:
        raise ValueError(f"no markers for {name}")
    head, _, rest = text.partition(start)
    return f"{head}{start}\n{made}\n{end}{rest.partition(end)[2]}"


def write_json(payload: object, path: str) -> None:
    """A report's payload on the driver."""
    with open(path, "w") as f:
        json.dump(payload, f, indent=2, default=str)
