"""Keyed fetches as a sink: tasks ask for their keys' records and write the bodies, and the commit enters them in the log.

``keys.write.format("fathom_fetch").options(url=..., folder=..., log=...).mode("append").save()`` takes rows with one string
column. Each task has a token bucket, so tasks times ``rate`` bounds the requests a second, and as many requests run at once
as tasks. A body is written under its key's name before the task's part of the log; parts of the log are moved into it when
all tasks have ended. So a run that is cut off at any place leaves bodies that no log knows, which are fetched and written
again, and never a log of bodies that are not there. The driver gets a path and counts from each task."""

from __future__ import annotations

import json
import time
import urllib.parse
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from fathom.sinks import store
from fathom.sources import files
from fathom.sources.http import fetch


class Bucket:
    """At most ``rate`` tokens a second on average and ``burst`` at once; ``take`` waits for one."""

    def __init__(self, rate: float, burst: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at = float(burst), clock()

    def take(self) -> None:
        now = self.clock()
        self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
        if self.tokens < 1:
            self.sleep((1 - self.tokens) / self.rate)
            now = self.clock()
            self.tokens, self.at = max(1.0, min(self.burst, self.tokens + (now - self.at) * self.rate)), now
        self.tokens -= 1


@dataclass
class Part(WriterCommitMessage):
    """A task's part of the log, and how many keys it has by status."""

    path: str
    counts: dict[str, int]


def body_name(key: str) -> str:
    return urllib.parse.quote(key, safe="") + ".json"


class FetchWriter(DataSourceWriter):
    """Options: url (with {key}), folder, log, key (the log's name for it, pulse_id), token, header, rate (2 a second), burst (1), strict (a key without an answer ends the run)."""

    def __init__(self, options: dict) -> None:
        self.options = options
        for name in ("url", "folder", "log"):
            if not options.get(name):
                raise ValueError(f"option {name} is missing")
        if "{key}" not in options["url"]:
            raise ValueError("the url has no {key}")

    @staticmethod
    def _system(uri: str):
        import pyarrow.fs as pafs

        return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")

    def _put(self, folder: str, name: str, data: bytes) -> None:
        system, base = self._system(folder)  # a name is no part of the URI: in one, its escapes would be read
        at = f"{base}/{name}"
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{at}.aside") as out:
            out.write(data)
        system.move(f"{at}.aside", at)

    def write(self, rows: Iterator) -> Part:
        o, lines, counts = self.options, [], {}
        bucket = Bucket(float(o.get("rate", "2")), int(o.get("burst", "1")))
        for row in rows:
            key = row[0]
            if not key:
                continue
            bucket.take()
            status, body = fetch(o["url"].replace("{key}", urllib.parse.quote(key, safe="")), o.get("token", ""), header=o.get("header", "Authorization"))
            told = "error" if body is None else "ok" if body.strip() else "empty"
            if told == "error" and o.get("strict", "").lower() == "true":
                raise OSError(f"{key}: status {status}")
            if told == "ok":
                self._put(o["folder"], body_name(key), body.encode())
            lines.append(json.dumps({o.get("key", "pulse_id"): key, "status": told, "chunks": 0, "error": "" if body is not None else f"status {status}"}))
            counts[told] = counts.get(told, 0) + 1
        folder, name = f"{o['log']}/_pending", f"{uuid.uuid4().hex}.json"
        if lines:
            self._put(folder, name, "".join(f"{x}\n" for x in lines).encode())
        return Part(f"{folder}/{name}" if lines else "", counts)

    def commit(self, messages: list[Part | None]) -> None:
        for m in messages:
            if m is not None and m.path:
                system, at = self._system(m.path)
                folder, _, name = at.rpartition("/")
                system.move(at, f"{folder.rpartition('/')[0]}/{name}")

    def abort(self, messages: list[Part | None]) -> None:
        """Parts of the log are dropped: their keys count as pending again."""
        for m in messages:
            if m is not None and m.path:
                system, at = self._system(m.path)
                system.delete_file(at)


class FetchSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fathom_fetch"

    def schema(self) -> str:
        return "key string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FetchWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FetchSink)


def fetch_pending(keys: DataFrame, url: str, folder: str, log: str, parallel: int = 5, key: str = "pulse_id", **options: str) -> DataFrame:
    """Fetches the keys that the log does not have as ``ok``, at most ``parallel`` at once, and returns the log's last record of each key.

    keys: rows with the column ``key``; blanks and repeats do not count."""
    spark = keys.sparkSession
    register(spark)
    wanted = keys.select(F.trim(key).alias("key")).where(F.coalesce("key", F.lit("")) != "").distinct()
    if any(n.endswith(".json") for n in store.names(spark, log)):
        done = files.checkpoint(spark, f"{log}/*.json", key).where("status = 'ok'")
        wanted = wanted.join(done.select(F.col(key).alias("key")), "key", "left_anti")
    wanted.repartition(parallel).write.format("fathom_fetch").options(url=url, folder=folder, log=log, key=key, **options).mode("append").save()
    return files.checkpoint(spark, f"{log}/*.json", key)
