"""Window panes with revisions: hourly totals of a stream that are published once due, and revised when late rows change them.

A pane is a kind and an hour of event time. ``W`` is the greatest event time of all rows of earlier batches. A pane is due
``DUE`` after its end and closed ``CLOSED`` after it. ``feed`` runs the stream for one batch: a Structured Streaming query,
started anew on the same checkpoint, that reads the batch's files and in update mode keeps counts and sums of the panes
(native ``groupBy`` over a window). Its watermark drops the state of closed panes. Rows of panes that are closed already
bypass the aggregation and reach the same ``foreachBatch`` by a union. There the changed panes are joined with the table of
open panes of the last batch, which tells what has been published, and that gives the batch's records:

late     a row of a closed pane (one record for each row)
emit     totals of a pane that is due and was not published before
retract, replace   the old and the new totals of a published pane that got rows
final    after the last batch, totals of panes that were never published

The table of open panes is written anew for each batch, and its marker last: a batch that is cut off at any place is run
again by the checkpoint and overwrites what it had written; one that is complete is not run again. Nothing but ``W`` goes to the driver.

Event times may lie before 1970, where Spark's first watermark stands; so the stream's clock is ahead by ``AHEAD`` years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm._storage import new_path

HOUR = 3_600_000_000
DUE, CLOSED = 6 * HOUR, 96 * HOUR
AHEAD = 10_000
SHIFT = AHEAD * 8_766 * HOUR
#: Of ``feed``'s rows; hour and event time count from 1970, us in microseconds.
ROW = "click_id long, kind string, us long, cents long"
OUT = "batch long, record string, kind string, hour long, click_id long, n_rows long, cents long"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def deliver(spark: SparkSession, staged: str, folder: str, batch: int) -> None:
    """Moves a staged batch to where the stream looks for files; one without rows becomes a file without rows."""
    source, target = f"{staged}/batch={batch}", f"{folder}/feed/batch={batch}"
    if _exists(spark, target):
        return
    if not _exists(spark, source):
        spark.createDataFrame([], ROW).write.mode("overwrite").parquet(source)
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(f"{folder}/feed"))
    if not system.rename(path(source), path(target)):
        raise OSError(f"{source} could not be moved to {target}")


def greatest(spark: SparkSession, folder: str, batch: int) -> int | None:
    """W: the greatest event time of the batches before, each of which has left its own; null without any row."""
    if not batch:
        return None
    return spark.read.schema("us long").parquet(*[f"{folder}/top/{b}" for b in range(batch)]).agg(F.max("us")).first()[0]


def feed(spark: SparkSession, folder: str, batch: int, last: bool, due: int = DUE, closed: int = CLOSED) -> None:
    """Runs the stream over the delivered batch of this number; its records go to ``folder``/out/batch=number."""
    w = greatest(spark, folder, batch)
    end = (F.col("hour") + 1) * HOUR
    is_closed = F.lit(False) if w is None else end + closed <= F.lit(w)
    is_due = F.lit(False) if w is None else end + due <= F.lit(w)
    rows = spark.readStream.schema(f"{ROW}, batch int").parquet(f"{folder}/feed").withColumn("hour", F.expr(f"(us - pmod(us, {HOUR})) DIV {HOUR}"))
    timed = rows.where(~is_closed).withColumn("at", F.timestamp_micros(F.col("us") + SHIFT)).withWatermark("at", f"{closed // 1000} milliseconds")
    panes = timed.groupBy("kind", F.window("at", "1 hour").alias("w"), "hour").agg(F.count("*").alias("n_rows"), F.sum("cents").alias("cents"))
    late = rows.where(is_closed).select("kind", "hour", "click_id", F.lit(1).cast("long").alias("n_rows"), "cents", F.lit(True).alias("late"))
    both = late.unionByName(panes.select("kind", "hour", F.lit(-1).cast("long").alias("click_id"), "n_rows", "cents", F.lit(False).alias("late")))
    held, out, marker = f"{folder}/panes", f"{folder}/out/batch={batch}", f"{folder}/panes/{batch}/_SUCCESS"

    def publish(changes: DataFrame, _: int) -> None:
        session = changes.sparkSession
        if _exists(session, marker):  # the records are out: a call for the watermark alone, or after a failure; the state is still to be kept
            changes.write.format("noop").mode("append").save()
            return
        changes.write.mode("overwrite").parquet(f"{folder}/changes/{batch}")
        changes = session.read.schema(both.schema).parquet(f"{folder}/changes/{batch}")
        shape = "kind string, hour long, n_rows long, cents long, published boolean"
        old = session.read.schema(shape).parquet(f"{held}/{batch - 1}") if batch else session.createDataFrame([], shape)
        new = changes.where("NOT late").select("kind", "hour", F.col("n_rows").alias("new_n"), F.col("cents").alias("new_cents"))
        now = old.join(new, ["kind", "hour"], "full_outer")
        was, changed = F.coalesce("published", F.lit(False)), F.col("new_n").isNotNull()
        totals = [F.coalesce("new_n", "n_rows").alias("n"), F.coalesce("new_cents", "cents").alias("c")]
        now = now.select("kind", "hour", "n_rows", "cents", *totals, was.alias("was"), changed.alias("changed"), is_due.alias("due"), is_closed.alias("closed"))
        record = lambda name, n, c: F.struct(F.lit(name).alias("record"), F.col(n).alias("n_rows"), F.col(c).alias("cents"))
        first = F.when(~F.col("was") & F.col("due"), F.array(record("emit", "n", "c")))
        if last:
            first = first.when(~F.col("was"), F.array(record("final", "n", "c")))
        made = F.explode(first.when(F.col("was") & F.col("changed"), F.array(record("retract", "n_rows", "cents"), record("replace", "n", "c"))))
        records = now.select("kind", "hour", F.lit(-1).cast("long").alias("click_id"), made.alias("r")).select("r.record", "kind", "hour", "click_id", "r.n_rows", "r.cents")
        bypassed = changes.where("late").select(F.lit("late").alias("record"), "kind", "hour", "click_id", "n_rows", "cents")
        records.unionByName(bypassed).write.mode("overwrite").parquet(out)
        arrived = session.read.schema(ROW).parquet(f"{folder}/feed/batch={batch}")
        arrived.agg(F.max("us").alias("us")).write.mode("overwrite").parquet(f"{folder}/top/{batch}")
        open_ = now.where(~F.col("closed")).select("kind", "hour", F.col("n").alias("n_rows"), F.col("c").alias("cents"), (F.col("was") | F.col("due")).alias("published"))
        open_.write.mode("overwrite").parquet(f"{held}/{batch}")

    stream = both.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", f"{folder}/checkpoint")
    query = stream.trigger(availableNow=True).start()
    query.awaitTermination()
    dropped = sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
    if dropped:
        raise AssertionError(f"{dropped} rows of open panes came after the watermark")
    if not _exists(spark, marker):
        raise RuntimeError(f"batch {batch} ended without its panes")


def run(rows: DataFrame, batches: int, due: int = DUE, closed: int = CLOSED) -> DataFrame:
    """The records of all batches. rows: batch, click_id, kind, us, cents; batches are fed in order of their number, from 0, also those without rows."""
    spark = rows.sparkSession
    folder = new_path(spark, "panes")
    rows.select("batch", "click_id", "kind", "us", "cents").write.partitionBy("batch").parquet(f"{folder}/staged")
    for batch in range(batches):
        deliver(spark, f"{folder}/staged", folder, batch)
        feed(spark, folder, batch, batch == batches - 1, due, closed)
    return spark.read.schema(OUT).parquet(f"{folder}/out")
