"""Structured Streaming: incremental pulls, keyed upserts and event-time windows, each with a batch twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.sinks import store, versioned


def since(rows: DataFrame, column: str, mark) -> DataFrame:
    """Rows changed after a mark; a null mark takes all."""
    return rows if mark is None else rows.where(F.col(column) > F.lit(mark))


def event_stream(spark: SparkSession, folder: str, schema, glob: str = "*", time: str = "ts", late: str | None = "1 day") -> DataFrame:
    """A stream of Parquet files with event time as TIMESTAMP (in UTC) and a watermark.

    What ``glob`` matches in the folder may be files or folders of files; as a pattern, a path may be either."""
    rows = spark.readStream.schema(schema).parquet(folder if glob == "*" else f"{folder}/{{{glob}}}")
    rows = rows.withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, late) if late else rows


def tumbling(rows: DataFrame, width: str, *by: str, time: str = "ts", value: str = "value", slide: str | None = None) -> DataFrame:
    """Counts and sums by window; with ``slide`` windows overlap."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = rows.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(rows: DataFrame, gap: str, by: str, time: str = "ts") -> DataFrame:
    out = rows.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def deduplicated(rows: DataFrame, *keys: str) -> DataFrame:
    """One row a key while the watermark remembers it."""
    return rows.dropDuplicatesWithinWatermark(list(keys)) if rows.isStreaming else rows.dropDuplicates(list(keys))


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that is there now, run through the stream into Parquet files under ``folder``, with its checkpoint beside them.

    In mode ``append`` a window comes out once the watermark has passed it; in ``complete`` each batch is a folder of its own,
    and the last complete one is read, so a batch that is cut off leaves the one before. Nothing is gathered on the driver."""
    spark, out = stream.sparkSession, f"{folder}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/{n:010}")).start()
    query.awaitTermination()
    if mode != "append":
        done = [n for n in store.names(spark, out) if store.exists(spark, f"{out}/{n}/_SUCCESS")]
        if not done:
            return spark.createDataFrame([], stream.schema)
        out = f"{out}/{done[-1]}"
    return spark.read.schema(stream.schema).parquet(out)


def unexpired(rows: DataFrame, time: str, days: int = 90, now=None) -> DataFrame:
    """Rows of the last days: what a refresh by time keeps of patterns that expire."""
    until = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return rows.where(F.col(time).cast("timestamp") > until - F.make_interval(days=F.lit(days)))


def upsert_into(stream: DataFrame, table: str, keys: list[str], checkpoint: str) -> None:
    """Everything there is now merged into a versioned table by key; a batch that is run again changes nothing."""

    def each(batch: DataFrame, number: int) -> None:
        versioned.upsert(batch, versioned.location(batch.sparkSession, table), keys, batch=(checkpoint, number))

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def pull(spark: SparkSession, all_keys: DataFrame, log: DataFrame, key: str, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Keys without an ``ok`` in the log, fetched: what a run that was cut off still has to do."""
    done = log.where("status = 'ok'").select(key)
    return fetch(all_keys.join(done, key, "left_anti"))
