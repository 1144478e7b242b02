"""The last value of each key, kept as stream state until its time is over.

``latest`` gives a row (key, time, value, state ``kept``) when a key gets a newer value, and one with state ``expired``
when the watermark passes the value's time by ``days``: the key is then forgotten, so state holds the keys of that span
alone. Of values with equal times the greater counts. Each task first reduces its rows to the last of a key, so a key that
holds a great part of a batch does not reach its task row by row."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


class Expiring(StatefulProcessor):
    def __init__(self, days: float) -> None:
        self.span = round(days * DAY_MS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, value string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        best = max((int(u), v) for pdf in rows for u, v in zip(pdf["us"], pdf["value"].fillna(""), strict=True))
        held = self.last.get() if self.last.exists() else None
        if held is not None and (held[0], held[1]) >= best:
            return
        if held is not None:
            self.handle.deleteTimer(self._end(held[0]))
        self.last.update(best)
        self.handle.registerTimer(self._end(best[0]))
        yield pd.DataFrame({"key": [key[0]], "us": [best[0]], "value": [best[1]], "state": ["kept"]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        us, value = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"key": [key[0]], "us": [us], "value": [value], "state": ["expired"]})

    def _end(self, us: int) -> int:
        return -(-us // 1000) + self.span

    def close(self) -> None:
        pass


def last_of_each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.sort_values(["us", "value"]).drop_duplicates("key", keep="last")


def latest(rows: DataFrame, key: str, value: str, days: float, late: str = "1 day", time: str = "ts") -> DataFrame:
    """(key, us, value, state) of a stream without a watermark, which is set here, ``late`` behind the greatest time seen.

    Rows without a key or a time are left out, a null value is ``''``."""
    named = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    named = named.select(F.col(key).cast("string").alias("key"), F.unix_micros(time).alias("us"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("value"), F.col(time).alias("at"))
    timed = named.mapInPandas(last_of_each, "key string, us long, value string, at timestamp").withWatermark("at", late)
    return timed.groupBy("key").transformWithStateInPandas(Expiring(days), "key string, us long, value string, state string", "Append", "EventTime")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, which timers need; the setting is put back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)
