"""A paged feed as a stream that can be stopped anywhere and goes on where it was.

``spark.readStream.format("fathom_feed").option("url", ...).load()`` gives (key, modified, body), one row for each version of
a record. A walk asks the feed for what changed since a mark and follows its pages. The stream's offset says all that a
batch needs to be read again: the pages, by URL, with the keys that are new on each, where the walk goes on, the mark, and
the keys that were seen with just that time, as feeds answer from the mark on, inclusive. Pages are planned in turn, as
each names the next, and read by a task each. At a walk's end the greatest time seen becomes the mark of the next.

A batch that is replayed asks for the same pages and takes the same keys. A record that has changed in between has a later
time and comes with the next walk; one that moves to another page between two batches of a walk can come twice, so keep
what comes by key (``sinks.versioned``). A page that fails ends the batch before it, and is asked for again in the next one."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from fathom.sources.http import fetch, paged_url

START = {"mark": "", "edge": [], "top": "", "top_edge": [], "next": "", "pages": [], "batch": 0}


class Page(InputPartition):
    def __init__(self, url: str, keys: list[str]) -> None:
        self.url, self.keys = url, keys


class FeedStreamReader(DataSourceStreamReader):
    """Options: url, key (id), modified (modified), page_size (20), pages (most pages with something new a batch, 50), token, modified_since."""

    def __init__(self, options: dict) -> None:
        get = lambda name, default="": options.get(name, default)
        self.url, self.token, self.key, self.modified = options["url"], get("token"), get("key", "id"), get("modified", "modified")
        self.page_size, self.most, self.since = int(get("page_size", "20")), int(get("pages", "50")), get("modified_since")
        self.at: dict | None = None

    def results(self, url: str) -> tuple[list[dict], str] | None:
        """The records of a page and the next page's URL; null where it does not answer."""
        _, body = fetch(url, self.token)
        if body is None:
            return None
        page = json.loads(body)
        return page.get("results", []), page.get("next") or ""

    def initialOffset(self) -> dict:
        return START | {"mark": self.since}

    def walk(self, start: dict) -> dict:
        """The offset after the pages that come next; ``start`` itself if there is nothing new."""
        url = start["next"] or paged_url(self.url, self.page_size, start["mark"] or None)
        top, edge = (start["top"], set(start["top_edge"])) if start["next"] else (start["mark"], set(start["edge"]))
        known, pages, ended = set(), [], False
        while len(pages) < self.most:
            found = self.results(url)
            if found is None:
                break
            rows, following = found
            before, keys = len(known), []
            for r in rows:
                key, time = str(r.get(self.key)), str(r.get(self.modified) or "")
                if key in known or time < start["mark"] or (time == start["mark"] and key in start["edge"]):
                    known.add(key)
                    continue
                known.add(key)
                keys.append(key)
                if time > top:
                    top, edge = time, set()
                if time == top:
                    edge.add(key)
            if keys:
                pages.append({"url": url, "keys": keys})
            if not following or len(known) == before:  # the last page, or pages that repeat
                ended = True
                break
            url = following
        if not pages and not (ended and start["next"]):
            return start
        end = {"top": top, "top_edge": sorted(edge), "pages": pages, "batch": start["batch"] + 1}
        if ended:
            return end | {"mark": top, "edge": sorted(edge), "next": ""}
        return end | {"mark": start["mark"], "edge": start["edge"], "next": url}

    def latestOffset(self) -> dict:
        self.at = self.walk(self.at or self.initialOffset())
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """The pages between two offsets. After a restart they are those of the log; the walk then goes on from ``end``."""
        if self.at is None or self.at["batch"] < end["batch"]:
            self.at = end
        return [] if end["batch"] == start["batch"] else [Page(p["url"], p["keys"]) for p in end["pages"]]

    def read(self, partition: Page) -> Iterator[tuple]:
        found = self.results(partition.url)
        if found is None:
            raise OSError(f"{partition.url} does not answer")
        wanted = set(partition.keys)
        for r in found[0]:
            if (key := str(r.get(self.key))) in wanted:
                wanted.remove(key)
                yield key, str(r.get(self.modified) or ""), json.dumps(r)

    def commit(self, end: dict) -> None:
        """Nothing is kept for batches that are done: the offset holds all."""


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fathom_feed"

    def schema(self) -> str:
        return "key string, modified string, body string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedSource)
