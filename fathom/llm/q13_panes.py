"""op13: hourly panes of ``clicks`` by kind, fed in eight batches, with late rows, emissions and revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import panes

NAME = "op13_window_panes"
BATCHES = 8
#: Cents that doubles tell exactly; other numbers, and those that are none, count as 0.
MOST = float(1 << 53)


def _micros(ts: Column) -> Column:
    """Microseconds since 1970 by the clock that the timestamp shows."""
    return (F.unix_date(F.to_date(ts)).cast("long") * 24 + F.hour(ts)) * panes.HOUR + F.minute(ts).cast("long") * 60_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def batched(clicks: DataFrame) -> DataFrame:
    """One row for each click_id (of several the least; null is an id like others) with its batch and event time.

    A row without arrival counts as arrived when it happened."""
    arrived = F.coalesce("arrived_at", "ts")
    day = F.unix_date(F.to_date(arrived)).cast("long")
    q = F.pmod(day, F.lit(BATCHES))
    spread = F.coalesce(F.crc32(F.col("click_id").cast("string").cast("binary")), F.lit(0)) % 30 - 23
    batch = F.least(F.lit(BATCHES - 1).cast("long"), q + F.greatest(F.lit(0).cast("long"), spread))
    cents = F.floor(100 * F.col("value") + 0.5)
    cents = F.when((100 * F.abs("value") < MOST) & ~F.isnan("value"), cents).otherwise(0).cast("long")
    us = _micros(F.col("ts")) - (day - q) * 24 * panes.HOUR
    rows = clicks.where("ts IS NOT NULL").select(F.col("click_id").cast("long").alias("click_id"), F.struct(us.alias("us"), batch.cast("int").alias("batch"), F.coalesce("kind", F.lit("none")).alias("kind"), cents.alias("cents")).alias("row"))
    return rows.groupBy("click_id").agg(F.min("row").alias("row")).select("click_id", "row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panes.run(batched(spark.read.parquet(f"{sf_dir}/clicks.parquet")), BATCHES)


def _crc32() -> str:
    """crc32 of the ASCII text ``t``, which DuckDB lacks: bit by bit, the least first."""
    bits = "[(ascii(t[(i // 8 + 1)::INTEGER])::BIGINT >> (i % 8)) & 1 FOR i IN range(8 * len(t))]"
    step = "xor(c >> 1, CASE WHEN xor(c & 1, b) = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce({bits}, lambda c, b: {step}, 4294967295::BIGINT), 4294967295)"


ORACLE_SQL = f"""
WITH t AS (SELECT click_id, click_id::VARCHAR AS t, epoch_us(ts) AS u, coalesce(arrived_at, ts)::DATE - DATE '1970-01-01' AS d, coalesce(kind, 'none') AS kind,
    CASE WHEN 100 * abs(value) < 9007199254740992 THEN floor(100 * value + 0.5)::BIGINT ELSE 0 END AS cents FROM clicks WHERE ts IS NOT NULL),
k AS (SELECT *, ((d % 8) + 8) % 8 AS q, coalesce({_crc32()}, 0) % 30 - 23 AS x FROM t),
r AS (SELECT click_id, min(struct_pack(us := u - (d - q) * {24 * panes.HOUR}, batch := least(7, q + greatest(0, x)), kind := kind, cents := cents)) AS r FROM k GROUP BY click_id),
e AS MATERIALIZED (SELECT click_id, r.us AS us, r.batch AS batch, r.kind AS kind, r.cents AS cents, (r.us - ((r.us % {panes.HOUR}) + {panes.HOUR}) % {panes.HOUR}) // {panes.HOUR} AS hour FROM r),
w AS (SELECT b AS batch, (SELECT max(us) FROM e WHERE e.batch < b) AS w FROM range(8) s(b)),
tagged AS (SELECT e.*, coalesce(w >= (hour + 1) * {panes.HOUR} + {panes.CLOSED}, false) AS late FROM e JOIN w USING (batch)),
p AS (SELECT kind, hour, batch, count(*) AS n, sum(cents)::BIGINT AS c FROM tagged WHERE NOT late GROUP BY ALL),
published AS (SELECT kind, hour, (SELECT min(w.batch) FROM w WHERE w.batch >= f AND w >= (hour + 1) * {panes.HOUR} + {panes.DUE}) AS b
  FROM (SELECT kind, hour, min(batch) AS f FROM p GROUP BY ALL)),
grid AS (SELECT x.kind, x.hour, x.b AS b, s.b AS batch, coalesce(p.n, 0) AS own, coalesce(p.c, 0) AS own_c, (sum(coalesce(p.n, 0)) OVER so_far)::BIGINT AS n, (sum(coalesce(p.c, 0)) OVER so_far)::BIGINT AS c
  FROM published x CROSS JOIN range(8) s(b) LEFT JOIN p ON p.kind = x.kind AND p.hour = x.hour AND p.batch = s.b WINDOW so_far AS (PARTITION BY x.kind, x.hour ORDER BY s.b))
SELECT batch, 'late' AS record, kind, hour, click_id, 1::BIGINT AS n_rows, cents FROM tagged WHERE late
UNION ALL SELECT batch, 'emit', kind, hour, -1, n, c FROM grid WHERE batch = b
UNION ALL SELECT batch, 'retract', kind, hour, -1, n - own, c - own_c FROM grid WHERE batch > b AND own > 0
UNION ALL SELECT batch, 'replace', kind, hour, -1, n, c FROM grid WHERE batch > b AND own > 0
UNION ALL SELECT batch, 'final', kind, hour, -1, n, c FROM grid WHERE batch = 7 AND b IS NULL
"""
