"""Summaries, downloads, feeds, traces and the library's entry points, beside small restatements."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import fathom
from fathom import observe
from fathom.functions import models, render
from fathom.operators import gold
from fathom.plans import bakeoff, ingest, summary
from fathom.sinks import cached, ensure_table, point_count, write_query_set
from fathom.sources import files, http
from fathom.streaming import unexpired


def test_models_by_name_and_task():
    assert models.model_name(" bge-m3 ") == "BAAI/bge-m3" and models.model_name("MiniLM") == "MiniLM"
    by = {"rewrite": "a", "analysis": "b", "report": "c", "anthropic": "d"}
    assert [models.routed(t, by) for t in models.TASKS] == ["a", "b", "c"]
    assert models.routed("report", by, "anthropic") == "d" and models.routed("report", by, "anthropic", "local") == "local"
    with pytest.raises(ValueError):
        models.routed("odd", by)


def test_scorers_and_writers_run_in_batches(spark):
    df = spark.createDataFrame([("q", "a b c"), ("q", None), (None, "x")], "q string, c string")
    scored = models.batch_scorer(lambda qs, cs: [float(len(c.split())) for c in cs], batch=2, longest=2)
    assert sorted(r[0] for r in df.select(scored("q", "c")).collect()) == [0.0, 1.0, 2.0]

    def write(prompt):
        if prompt == "x":
            raise OSError
        return prompt.upper()

    assert sorted(df.select(models.batch_writer(write, tries=2, wait=0.0)("c")).collect(), key=repr) == sorted([("A B C",), (None,), (None,)], key=repr)


def test_capabilities_are_told_apart(spark):
    at = lambda n: dt.datetime(2024, 1, n)
    rows = [
        ("certificate", "new", at(3), {"technique": {"enterprise": {"micro_f1": 0.5, "pass": False}}, "actor": {"plausible_acc": 0.7, "pass": True}}),
        ("certificate", "old", at(1), {"technique": {"enterprise": {"micro_f1": 0.7, "pass": True, "n": 3}}, "thresholds": {"tech_micro_f1": 0.65}, "actor": {"plausible_acc": 0.9}}),
        ("certificate", "empty", at(9), {"technique": {}, "actor": None}),
        ("attribution", "none", at(4), {"results": []}),
        ("attribution", "one", at(2), {"results": [{"by_category": {"a": {"hit_at_k": 1}}}]}),
        ("answers", "told", at(2), {"faithfulness": 0.9, "context_recall": 0.5}),
    ]
    told = lambda rows: summary.report(summary.capabilities(spark.createDataFrame([(*r[:3], json.dumps(r[3])) for r in rows], summary.SAVED)))
    own = told(rows)
    assert own["technique_extraction"] == {"status": summary.FOUND, "source": "old", "micro_f1": 0.7, "n": 3, "pass": True, "threshold": 0.65}
    assert own["actor_attribution"] == {"status": summary.FOUND, "source": "new", "plausible_acc": 0.7, "pass": True}
    assert own["heterogeneous_retrieval"] == {"status": summary.FOUND, "source": "one", "by_category": {"a": {"hit_at_k": 1}}}
    assert own["generation_grounding"] == {"status": summary.FOUND, "source": "told", "faithfulness": 0.9}
    assert told([("answers", "x", at(1), {"references_available": True, "context_recall": 0.5})])["generation_grounding"]["context_recall"] == 0.5
    none = told([])
    assert [none[c]["status"] for c in sorted(none)] == [summary.NONE, summary.NOT_RUN, summary.NONE, summary.NONE]
    blocked = told([("answers", "x", at(1), {"status": "BLOCKED: quota", "n_requested": 4})])["generation_grounding"]
    assert blocked == {"status": "BLOCKED: quota", "source": "x", "n_requested": 4}


def test_saved_records_by_kind(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"r{n}.json").write_text(json.dumps({"n": n}))
    import os

    os.utime(tmp_path / "r1.json", (2_000_000_000, 2_000_000_000))
    rows = summary.saved(spark, answers=f"{tmp_path}/r*.json", certificate=f"{tmp_path}/none")
    assert rows.count() == 2 and summary.report(summary.capabilities(rows))["generation_grounding"]["n"] == 1
    text = spark.read.text(f"{tmp_path}/r*.json", wholetext=True).select("value", "_metadata.file_path", "_metadata.file_modification_time")
    assert files.newest_where(text, F.get_json_object("value", "$.n") == "2").first()["file_path"].endswith("r2.json")
    with pytest.raises(ValueError, match="lacks config"):
        files.saved_metrics(spark, f"{tmp_path}/r1.json")


def test_query_sets_caches_tables_and_counts(spark, tmp_path):
    rows = spark.createDataFrame([("b", "two"), ("a", "one")], "query_id string, query string")
    write_query_set(rows, f"{tmp_path}/q")
    assert [r["query_id"] for r in files.lines(spark, f"{tmp_path}/q", "query_id string, query string").collect()] == ["a", "b"]
    made = []
    make = lambda: made.append(1) or rows
    for most in (None, 1):
        got = cached(spark, f"{tmp_path}/cache", make, "query_id string, query string", most, "query_id").collect()
        assert len(got) == (most or 2) and len(made) == 1
    spark.sql("DROP TABLE IF EXISTS made_here")
    assert ensure_table(spark, "made_here", "id string, source string", "source") and not ensure_table(spark, "made_here", "id string")
    spark.sql("DROP TABLE made_here")
    points = spark.createDataFrame([("otx",), ("otx",), ("pdf",)], "source string")
    assert point_count(points) == 3 and point_count(points, "otx") == 2
    assert {r["id"] for r in files.pooled([spark.range(50), spark.range(50, 100)], 7).collect()} == {r["id"] for r in files.pooled([spark.range(100).repartition(5)], 7).collect()}


def test_reports_are_fetched_once_and_checked(tmp_path, monkeypatch):
    class Answer:
        headers = {"content-type": "text/html"}

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

        def read(self, n):
            return b"x" * 10

    import urllib.request

    calls = []
    monkeypatch.setattr(urllib.request, "urlopen", lambda url, timeout: calls.append(url) or Answer())
    folder = f"file://{tmp_path}/r"
    assert files.download("http://h/a", folder, "a.pdf", dry_run=True) and not calls
    assert not files.download("http://h/a", folder, "a.pdf") and files.download("http://h/a.PDF", folder, "a.pdf") and files.download("http://h/a.PDF", folder, "a.pdf")
    assert len(calls) == 2 and (tmp_path / "r" / "a.pdf").read_bytes() == b"x" * 10
    monkeypatch.setattr(files, "MOST_BYTES", 4)
    assert not files.download("http://h/b.pdf", folder, "b.pdf")


def test_raw_text_is_written_before_its_key_is_done():
    order = []
    bodies = {"a": (200, "{}"), "b": (404, None), "c": (200, " ")}
    got = http.fetch_raw(["a", "b", "a", "c"], bodies.get, lambda k, b: order.append(("raw", k)), lambda k, s: order.append((s, k)))
    assert got == {"ok": 1, "empty": 1, "error": 1} and order == [("raw", "a"), ("ok", "a"), ("error", "b"), ("empty", "c")]
    assert http.paged_url("http://h/f", 5, "2024-01-01") == "http://h/f?limit=5&modified_since=2024-01-01" and http.paged_url("http://h/f?x=1").endswith("?x=1&limit=20")


def test_a_feed_is_read_page_by_page(spark, monkeypatch):
    pages = {"http://h/f?limit=2&modified_since=m": {"results": [{"id": 1}, {"id": 2}], "next": "n"}, "n": {"results": [{"id": 2}, {"id": 3}], "next": "n2"}, "n2": {"results": [{"id": 3}], "next": "n"}}
    monkeypatch.setattr(http, "fetch", lambda url, token="": (200, json.dumps(pages[url])))
    reader = http.HttpSource({"feed": "true", "url": "http://h/f", "page_size": "2", "modified_since": "m"}).reader(None)
    assert [k for k, _, _ in reader.read(None)] == ["1", "2", "3"]


def test_documents_changed_since_a_mark(spark):
    rows = [("a", '{"last_modified": "2024-01-01"}'), ("b", '{"last_modified": "2024-03-01"}'), ("c", "{}"), ("d", '{"last_seen": "2024-04-01"}')]
    docs = spark.createDataFrame(rows, "id string, metadata string")
    assert [r["id"] for r in ingest.changed_since(docs, "2024-02-01").orderBy("id").collect()] == ["b", "c", "d"] and ingest.changed_since(docs, None).count() == 4
    now = "2024-04-10"
    kept = unexpired(spark.createDataFrame([("2024-01-01",), ("2024-03-01",)], "ts string"), "ts", 90, now)
    assert [r["ts"] for r in kept.collect()] == ["2024-03-01"]


def test_bakeoff_ranks_models(spark):
    corpus = spark.createDataFrame([("c1", "red fox"), ("c2", "blue dog"), ("c3", "green cat")], "chunk_id string, content string")
    queries = spark.createDataFrame([(1, "fox red"), (2, "dog blue")], "query_id int, text string")
    truth = spark.createDataFrame([(1, "c1"), (2, "c2")], "query_id int, gold string")
    got = bakeoff.run(corpus, queries, truth, {"none": lambda c: F.array(F.lit(0.0), F.lit(0.0)), "words": models.hashed_vector(32)}, k=1).collect()
    assert [r["name"] for r in got] == ["words", "none"] and got[0]["recall_at_k"] == got[0]["mrr"] == 1.0 and got[1]["recall_at_k"] == 0.5
    assert gold.GATE == "defense-evasion"


def test_gate_traces_and_paths(spark, monkeypatch, caplog):
    nodes = spark.createDataFrame([([("k", "defense-evasion")],), (None,)], "phases array<struct<kill_chain_name:string,phase_name:string>>")
    assert nodes.agg(gold.has_gate(nodes)).first()[0] and not nodes.limit(0).agg(gold.has_gate(nodes)).first()[0]
    f = observe.traced("job")(lambda x: x + 1)
    assert f(1) == 2 and not caplog.records
    monkeypatch.setenv("FATHOM_TRACE", "1")
    with caplog.at_level("INFO", "fathom"):
        assert f(1) == 2
    assert "job took" in caplog.text
    assert render.relative_path("/a/b/c", "/a") == "b/c" and render.relative_path("/x/y", "/a") == "/x/y"
    assert render.with_embedding_model(spark.range(1), "m").first()["embedding_model"] == "m"


def test_library_entry_points(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), "otx", t) for i, t in enumerate(["alpha beta", "gamma delta", "alpha delta"])], "id string, source string, content string")
    ingest.seed(docs.withColumn("retrieved_at", F.lit("2026-01-01T00:00:00")), f"{tmp_path}/c")
    table = f"{tmp_path}/entry_points"
    ingest.load(spark, {"otx": f"{tmp_path}/c"}, table)
    more = {"spark": spark, "table": table, "model": f"{tmp_path}/model"}
    assert fathom.query("alpha beta", 1, **more).first()["content"] == "alpha beta"
    ingest.seed(docs.limit(1).withColumn("content", F.lit("omega delta")).withColumn("retrieved_at", F.lit("2026-01-02T00:00:00")), f"{tmp_path}/c3")
    ingest.load(spark, {"otx": f"{tmp_path}/c3"}, table)
    assert fathom.query("delta", 3, **more).where("content = 'omega delta'").count() == 1
    said = fathom.answer("alpha", 2, write=lambda p: F.lit("so it is [x1]"), **more).first()
    assert said["answer"] == "so it is [x1]" and said["cited"] == ["x1"]
    with pytest.raises(Exception, match="gave no answer"):
        fathom.answer("alpha", 2, write=models.no_model, raise_on_failure=True, **more).collect()
