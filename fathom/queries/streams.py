"""Streams over ``events`` drained once to files, beside the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.queries import query, table
from fathom.sinks import new_folder
from fathom.streaming import deduplicated, drain, event_stream, expiry, sessions, tumbling


def _events(spark, d, late: str | None = "1 day"):
    return event_stream(spark, d, table(spark, d, "events").schema, "events.parquet", late=late)


def _drain(rows, mode="complete"):
    return drain(rows, new_folder(rows.sparkSession, "stream"), mode)


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    out = _drain(tumbling(_events(spark, d), "1 day", "event_type"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT start, count(*) AS n, round(sum(value), 4) AS total FROM (
  SELECT value, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR])::TIMESTAMP AS start FROM events) GROUP BY start""")
def stream_sliding(spark, d):
    out = _drain(tumbling(_events(spark, d), "1 day", slide="12 hours"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT * FROM a ORDER BY user_id, ts))
SELECT user_id, min(ts) AS start, (max(ts) + INTERVAL 6 HOUR)::TIMESTAMP AS "end", count(*) AS n FROM b GROUP BY user_id, s""")
def stream_session(spark, d):
    out = _drain(sessions(_events(spark, d), "6 hours", "user_id"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, d):
    rows = _events(spark, d, late="60 days").select("ts", "user_id", "event_type")
    return _drain(deduplicated(rows, "user_id", "event_type"), "append").select("user_id", "event_type")


@query("""WITH c AS (SELECT client_id, ts, coalesce(kind, '') AS kind FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
l AS (SELECT client_id, max(struct_pack(ts := ts, kind := kind)) AS r FROM c GROUP BY client_id)
SELECT client_id, epoch_us(r.ts) AS us, r.kind AS kind, 'kept' AS state FROM l UNION ALL
SELECT client_id, epoch_us(r.ts), r.kind, 'expired' FROM l WHERE r.ts + INTERVAL 10 DAY <= (SELECT max(ts) FROM c) - INTERVAL 1 DAY""")
def stream_expiry(spark, d):
    """Each client's last click, forgotten ten days later by a timer."""
    rows = event_stream(spark, d, table(spark, d, "clicks").schema, "clicks.parquet", late=None)
    with expiry.rocks(spark):
        out = _drain(expiry.latest(rows, "client_id", "kind", 10), "append")
    return out.select(F.col("key").cast("long").alias("client_id"), "us", F.col("value").alias("kind"), "state")
