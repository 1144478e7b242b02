"""A crawl by rounds: pages of the frontier are fetched by tasks, and their links, minus what was visited, are the next frontier.

A round is a table in the shared folder, so a crawl that is cut off has lost the round it was in at most, and goes on from
those that are there. URLs are dealt by host, and a host's in turn with a token bucket, so no site is asked faster than
``rate`` a second, however many tasks there are. Which URLs have been visited is an anti-join against the rounds' tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.text import safe_filename
from fathom.sinks import store
from fathom.sinks.fetch import Bucket
from fathom.sources import files
from fathom.sources.http import fetch

PAGE = "url string, status int, html string"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def _by_host(urls: DataFrame) -> DataFrame:
    return urls.withColumn("host", host(F.col("url"))).repartition("host").sortWithinPartitions("host", "url")


def pages(urls: DataFrame, rate: float = 1.0, token: str = "") -> DataFrame:
    """(url, status, html) of each URL; those that do not answer have no html."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, bucket = None, Bucket(rate)
        for pdf in batches:
            out = []
            for url, site in zip(pdf["url"], pdf["host"], strict=True):
                if site != now:
                    now, bucket = site, Bucket(rate)
                bucket.take()
                out.append((url, *fetch(url, token)))
            yield pd.DataFrame(out, columns=["url", "status", "html"])

    return _by_host(urls.select("url")).mapInPandas(work, PAGE)


def rounds_of(spark: SparkSession, folder: str) -> list[str]:
    """The rounds of a crawl that are complete."""
    return [f"{folder}/{n}" for n in store.names(spark, folder) if n.startswith("round-") and store.exists(spark, f"{folder}/{n}/_SUCCESS")]


def crawl(start: DataFrame, folder: str, hops: int, follow: Callable[[Column, Column], Column] | None = None, rate: float = 1.0, token: str = "") -> DataFrame:
    """(url, status, html, hop) of all pages within ``hops`` links of the start (a column ``url``), each fetched once.

    follow: of a link and the page that it is on, whether it is gone after; without it, those of the page's own host are. Only http and https are."""
    spark = start.sparkSession
    follow = follow or (lambda link, page: host(link) == host(page))
    for hop in range(hops + 1):
        path = f"{folder}/round-{hop:04}"
        if path in (done := rounds_of(spark, folder)):
            continue
        if hop == 0:
            frontier = start.select(without_fragment(F.col("url")).alias("url"))
        else:
            last = spark.read.schema(PAGE).parquet(done[-1])
            links = files.links(last.where("html IS NOT NULL"))
            frontier = links.where(follow(F.col("link"), F.col("url"))).select(without_fragment(F.col("link")).alias("url"))
        frontier = frontier.where(F.lower("url").rlike("^https?://")).distinct()
        if done:
            frontier = frontier.join(spark.read.schema(PAGE).parquet(*done).select("url"), "url", "left_anti")
        pages(frontier, rate, token).write.mode("overwrite").parquet(path)
    rows = spark.read.schema(PAGE).parquet(*rounds_of(spark, folder)[: hops + 1])
    return rows.select("*", F.regexp_extract("_metadata.file_path", r"round-([0-9]+)/", 1).cast("int").alias("hop"))


def reports(found: DataFrame, folder: str, rate: float = 1.0) -> DataFrame:
    """(url, filename, kept): links (a column ``link``) to reports, each downloaded once by the task that has its host; what is there already is not fetched again."""
    urls = found.select(F.col("link").alias("url")).distinct()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, bucket = None, Bucket(rate)
        for pdf in batches:
            kept = []
            for url, site, name in zip(pdf["url"], pdf["host"], pdf["filename"], strict=True):
                if site != now:
                    now, bucket = site, Bucket(rate)
                bucket.take()
                kept.append(files.download(url, folder, name))
            yield pdf.assign(kept=kept)[["url", "filename", "kept"]]

    named = urls.withColumn("filename", F.concat(F.substring(F.sha2("url", 256), 1, 12), F.lit("-"), safe_filename(F.col("url"))))
    return _by_host(named).mapInPandas(work, "url string, filename string, kept boolean")
