"""Command line: ``python -m fathom.cli query|seed|ingest|refresh|fetch|eval|certify|summary|metrics ...``."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.models import hashed_vector
from fathom.functions.render import snippet
from fathom.operators import metrics as M
from fathom.operators.retrieval import overlap_score
from fathom.plans import certification, evaluation, ingest, summary
from fathom.plans import retrieval as plans
from fathom.plans.settings import get_settings
from fathom.sinks import markdown, write_json
from fathom.sinks.fetch import fetch_pending
from fathom.sources import feeds, files, stix

SOURCES = ("mitre", "relationships", "otx", "whois", "pdns", "virustotal")


def session() -> SparkSession:
    return SparkSession.builder.appName("fathom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def read_source(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """The documents of a source's raw files."""
    if kind in ("mitre", "relationships"):
        return (stix.techniques if kind == "mitre" else stix.relationships)(stix.read_objects(spark, path))
    schema, make = {"otx": (feeds.PULSE, feeds.pulses), "whois": (feeds.WHOIS, feeds.whois), "pdns": (feeds.PDNS, feeds.passive_dns), "virustotal": (feeds.SCAN, feeds.scans)}[kind]
    return make(spark.read.schema(schema).json(path))


def search(a: argparse.Namespace) -> int:
    spark = session()
    queries = spark.createDataFrame([(0, a.text)], "query_id int, text string")
    found = plans.build(ingest.stored_index(spark, a.table, a.model), a.config, embed=hashed_vector(), score=overlap_score).run(queries, a.k, a.source)
    rows = found.select((F.col("rank") + 1).alias("rank"), F.round("score", 4).alias("score"), "source", F.substring("chunk_id", 1, 12).alias("id"), snippet(F.col("content")).alias("content"))
    print(markdown(rows.orderBy("rank")))
    return 0


def seed(a: argparse.Namespace) -> int:
    made = ingest.seed(read_source(session(), a.kind, a.path), a.out, a.strategy, a.limit)
    print(json.dumps(made))
    return 0


def load(a: argparse.Namespace) -> int:
    print(json.dumps(ingest.load(session(), dict(p.split("=", 1) for p in a.files), a.table)))
    ingest.index_table(session(), a.table, a.model, a.refit)
    return 0


def fetch(a: argparse.Namespace) -> int:
    """The records of keys in a file (one a line), those that the log has as done left out; counts by status."""
    keys = session().read.text(a.keys).select(F.col("value").alias(a.key))
    told = fetch_pending(keys, a.url, a.folder, a.log, a.parallel, a.key, rate=str(a.rate), token=os.environ.get("FATHOM_FEED_TOKEN", ""), header=a.header)
    print(json.dumps({r["status"]: r["n"] for r in told.groupBy("status").agg(F.count("*").alias("n")).collect()}))
    return 0


def refresh(a: argparse.Namespace) -> int:
    """Documents that their source changed after a mark, or of which it does not say when, chunked again."""
    docs = read_source(session(), a.kind, a.path)
    print(json.dumps(ingest.seed(ingest.changed_since(docs, a.since), a.out)))
    return 0


def evaluate(a: argparse.Namespace) -> int:
    spark = session()
    queries = files.query_set(spark, a.queries, a.suite == "retrieval")
    asked = queries.select("query_id", F.col("query").alias("text"))
    built, rows = ingest.stored_index(spark, a.table, a.model), []
    for config in dict.fromkeys(a.config):
        results = plans.build(built, config, get_settings(), hashed_vector(), overlap_score).run(asked, max(a.k))
        found = evaluation.query_set(results, queries, sorted(set(a.k))) if a.suite == "retrieval" else evaluation.attribution(results, queries, sorted(set(a.k)))[0]
        rows += [{"config": config, **r.asDict()} for r in found.collect()]
    if a.out:
        write_json(rows, a.out)
    print(json.dumps(rows, indent=1))
    return 0


def certify(a: argparse.Namespace) -> int:
    """Saved predictions (JSON lines: id, platform, gold, predicted) and verdicts (id, verdict) against their gates; a failed one is an error."""
    spark = session()
    techniques = spark.read.schema("id string, platform string, gold array<string>, predicted array<string>").json(a.techniques)
    actors = spark.read.schema("id string, verdict string").json(a.actors)
    passed = certification.run(techniques, actors, a.out)
    print(certification.report(techniques, actors))
    return int(not passed)


def summarise(a: argparse.Namespace) -> int:
    """What saved results tell of each capability."""
    rows = summary.saved(session(), certificate=a.certificates, attribution=a.attribution, answers=a.answers)
    print(json.dumps(summary.report(summary.capabilities(rows)), indent=1))
    return 0


def show_metrics(a: argparse.Namespace) -> int:
    """A saved evaluation with its alerts; ``--strict`` makes any alert an error."""
    with open(a.path) as f:
        saved = json.load(f)
    known = {(c, int(k)): least for c, k, least in M.ALERTS}
    low = [r for r in saved if (r["category"], int(r["k"])) in known and r["hit_rate"] < known[r["category"], int(r["k"])]]
    for r in saved:
        print(f"{r['config']:14} {r['category']:20} @{r['k']:<3} hit {r['hit_rate']:.4f}  mrr {r['mrr']:.4f}")
    for r in low:
        print(f"ALERT {r['config']} {r['category']} @{r['k']}: {r['hit_rate']:.4f} is under {known[r['category'], int(r['k'])]}", file=sys.stderr)
    return int(bool(low) and a.strict)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fathom")
    sub = top.add_subparsers(required=True)

    def command(name: str, run: Callable[[argparse.Namespace], int]) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        return p

    def stored(p: argparse.ArgumentParser) -> None:
        p.add_argument("--table", default="points")
        p.add_argument("--model", default="model")

    q = command("query", search)
    q.add_argument("text")
    q.add_argument("-k", type=int, default=10)
    q.add_argument("--config", default="hybrid")
    q.add_argument("--source")
    stored(q)
    for name, run in (("seed", seed), ("refresh", refresh)):
        p = command(name, run)
        p.add_argument("kind", choices=SOURCES)
        p.add_argument("path")
        p.add_argument("out")
        p.add_argument("--strategy")
        p.add_argument("--limit", type=int)
        p.add_argument("--since")
    i = command("ingest", load)
    i.add_argument("files", nargs="+", help="source=path")
    i.add_argument("--refit", action="store_true", help="fit the terms' weights anew")
    stored(i)
    f = command("fetch", fetch)
    for name in ("keys", "url", "folder", "log"):
        f.add_argument(name)
    f.add_argument("--key", default="pulse_id")
    f.add_argument("--header", default="Authorization", help="where FATHOM_FEED_TOKEN goes, if it is set")
    f.add_argument("--parallel", type=int, default=5)
    f.add_argument("--rate", type=float, default=2.0)
    e = command("eval", evaluate)
    e.add_argument("suite", choices=("retrieval", "attribution"))
    e.add_argument("queries")
    e.add_argument("-k", type=int, nargs="+", default=[1, 5, 10])
    e.add_argument("-c", "--config", nargs="+", default=["dense", "hybrid"])
    e.add_argument("-o", "--out")
    stored(e)
    c = command("certify", certify)
    for name in ("techniques", "actors", "out"):
        c.add_argument(name)
    s = command("summary", summarise)
    for name in ("certificates", "attribution", "answers"):
        s.add_argument(f"--{name}", default=f"data/{name}*.json")
    m = command("metrics", show_metrics)
    m.add_argument("path")
    m.add_argument("--strict", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
