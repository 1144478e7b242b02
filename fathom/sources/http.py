"""Keyed HTTP lookups as a Python data source.

``spark.read.format("fathom_http").option("keys", "a,b").option("url", "https://host/{key}").load()`` gives
(key, status, body). The number of partitions bounds how many requests run at once; each request is tried again,
waiting longer each time, on faults, 429 and 5xx. A key that fails is a row with its status and no body. With the option
``feed`` the URL is a paged feed: its pages (``next``) are read in turn, from ``modified_since`` on if that is given, until
there is none or a page repeats."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TRIES, LEAST_WAIT, MOST_WAIT, TIMEOUT = 3, 2.0, 30.0, 30.0


def retryable(status: int) -> bool:
    return status == 429 or status >= 500


def fetch(url: str, token: str = "", sleep: Callable[[float], None] = time.sleep, header: str = "Authorization") -> tuple[int, str | None]:
    """(status, body); status 0 where no answer came."""
    status = 0
    for n in range(TRIES):
        request = urllib.request.Request(url, headers={header: f"Bearer {token}" if header == "Authorization" else token} if token else {})
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:  # noqa: S310
                return answer.status, answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            status = e.code
            if not retryable(status):
                return status, None
        except OSError:
            status = 0
        if n + 1 < TRIES:
            sleep(min(MOST_WAIT, LEAST_WAIT * 2**n))
    return status, None


def pages(url: str, get: Callable[[str], tuple[int, str | None]], key: str = "id") -> Iterator[dict]:
    """The results of a paged feed; ends at the last page, a failed one, or one without a new key."""
    seen: set = set()
    while url:
        _, body = get(url)
        if body is None:
            return
        page = json.loads(body)
        fresh = [r for r in page.get("results", []) if r.get(key) not in seen]
        if not fresh:
            return
        for r in fresh:
            if r.get(key) not in seen:
                seen.add(r.get(key))
                yield r
        url = page.get("next") or ""


def paged_url(url: str, page_size: int = 20, modified_since: str | None = None) -> str:
    """The first page of a feed, of what changed since a mark if one is given."""
    more = f"limit={page_size}" + (f"&modified_since={urllib.request.quote(modified_since)}" if modified_since else "")
    return url + ("&" if "?" in url else "?") + more


def fetch_raw(keys: list[str], get: Callable[[str], tuple[int, str | None]], write: Callable[[str, str], None], done: Callable[[str, str], None]) -> dict[str, int]:
    """Keys fetched, each body written before its key is noted as done: a run cut off in between fetches it again and loses nothing. Counts by status."""
    counts = {"ok": 0, "empty": 0, "error": 0}
    for key in dict.fromkeys(keys):
        status, body = get(key)
        name = "error" if body is None else "ok" if body.strip() else "empty"
        if name == "ok":
            write(key, body)
        done(key, name)
        counts[name] += 1
    return counts


class _Part(InputPartition):
    def __init__(self, keys: list[str]) -> None:
        self.keys = keys


class HttpReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.url, self.token = options["url"], options.get("token", "")
        keys = [k for k in options.get("keys", "").split(",") if k]
        n = max(1, min(len(keys), int(options.get("parallel", "5"))))
        self.parts = [keys[i::n] for i in range(n)]

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.parts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for k in partition.keys:
            status, body = fetch(self.url.replace("{key}", urllib.request.quote(k, safe="")), self.token)
            yield k, status, body


class FeedReader(DataSourceReader):
    """A paged feed is one partition: each page names the next."""

    def __init__(self, options: dict) -> None:
        self.url = paged_url(options["url"], int(options.get("page_size", "20")), options.get("modified_since"))
        self.token, self.key = options.get("token", ""), options.get("key", "id")

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for r in pages(self.url, lambda url: fetch(url, self.token), self.key):
            yield str(r.get(self.key)), 200, json.dumps(r)


class HttpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fathom_http"

    def schema(self) -> str:
        return "key string, status int, body string"

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return FeedReader(options) if options.get("feed", "").lower() == "true" else HttpReader(options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpSource)
