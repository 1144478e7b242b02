"""Operators beside small restatements in Python."""

import json
import math
import random
import re
import uuid

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from fathom.functions import models, render
from fathom.functions import text as T
from fathom.functions.tokens import PATTERN, indicators, tokenize, tokenized
from fathom.operators import chunking, graph, keyed, metrics, retrieval, sections
from fathom.plans import evaluation, ingest
from fathom.plans import retrieval as plans
from fathom.plans.settings import Settings, alpha
from fathom.sinks import append_log, markdown, splice, upsert_table, versioned, write_chunks
from fathom.sources import feeds, files, http, stix


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


# --- functions ---------------------------------------------------------------------------------


def test_scalars(spark):
    assert one(spark, " \t a \t b\n\n\n\nc \n", T.clean) == "a b\n\nc"
    assert one(spark, " \n ", T.clean) is None
    assert one(spark, "c-1", T.point_id) == str(uuid.uuid5(uuid.UUID("d7b3a5a6-4f72-4e86-9b88-2e5f5d8a1c3e"), "c-1"))
    assert one(spark, " t1059.001 ", T.technique) == "T1059" and one(spark, " t1059.001 ", lambda c: T.technique(c, "subtechnique")) == "T1059.001"
    with pytest.raises(ValueError):
        T.technique(F.col("x"), "odd")
    assert one(spark, "T1059 t1059 T1003.001 T1059", T.technique_ids) == ["T1059", "T1003.001"]
    assert one(spark, "see [b_2] and [a-1], [b_2] [no way]", T.cited_ids) == ["b_2", "a-1"]
    assert one(spark, '\n  **"APT Example"**\nmore', T.actor_name) == "APT Example"
    assert one(spark, "NONE.", T.actor_name) == "" and one(spark, None, T.actor_name) == ""
    assert one(spark, "API-Key: abc, token = Bearer xyz", T.redact) == "API-Key=<redacted> token=<redacted>"
    assert one(spark, "https://h.example/a/b c.PDF?x=1", T.safe_filename) == "b_c.PDF"
    assert one(spark, "https://h.example/a/", T.safe_filename) == "a.pdf"
    assert one(spark, "attack-pattern--x--1", T.reference_type) == "attack-pattern--x" and one(spark, "none", T.reference_type) == "none"
    assert one(spark, 1717200000, T.iso_from_epoch, "long") == "2024-06-01T00:00:00+00:00" and one(spark, None, T.iso_from_epoch, "long") == ""
    assert one(spark, "  one two\tthree ", T.word_count) == 3
    assert one(spark, "Direct: APT One -> x; tactic = defense-evasion", T.note_actor) == "APT One"
    assert one(spark, "Direct: APT One -> x; tactic = defense-evasion", T.note_tactic) == "defense-evasion"
    links = {"/p": "http://h.example/p", "q": "http://h.example/d/q", "//o.example/z": "http://o.example/z", "https://x/": "https://x/"}
    for link, want in links.items():
        assert one(spark, link, lambda c: T.resolve_url(F.lit("http://h.example/d/e?f"), c)) == want


def words(text):
    out, at = [], 0
    for m in re.finditer(PATTERN, text):
        out += [w.lower() for w in re.split(r"[\s\W]+", text[at : m.start()]) if 2 <= len(w) <= 64] + [m[0].lower()]
        at = m.end()
    return out + [w.lower() for w in re.split(r"[\s\W]+", text[at:]) if 2 <= len(w) <= 64]


def test_tokens(spark):
    rng = random.Random(3)
    bits = ["a.b.com", "foo", "-", "T1059", "t1059.001", "cve-2020-12345", "MS17-010", "1.2.3.4", "/24", "255.255.255.256", "aa:bb:cc:dd:ee:ff", ":", "_", "é", "deadbeef" * 4, "deadbeef" * 5, "deadbeef" * 8, "a" * 70, ".", "com", "x.co", " ", "9"]
    texts = ["256.1.2.3 xT1059y", "10.0.0.0/8x 1.2.3.4/33", "CVE-2021-44228 and foo.community a bb " + "q" * 65, "é_ü AB:cd:EF:01:23:45 " + "a1" * 32, "", "ms17-010! example.co.uk"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    rows = tokenized(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", "n").select("i", tokenize(F.col("t")).alias("w"), "n", indicators(F.col("t")).alias("ind")).collect()
    for r in rows:
        assert sorted(r["w"]) == sorted(r["n"]) == sorted(words(texts[r["i"]])), texts[r["i"]]
        assert r["ind"] == [m[0].lower() for m in re.finditer(PATTERN, texts[r["i"]])]


def test_prose_is_in_normal_form_and_indicators_are_not(spark):
    df = spark.createDataFrame([("\ufb01le \uff34\uff11\uff10\uff15\uff19.\uff10\uff10\uff11 evil.com \u00bdx",), ("file",), (None,)], "t string")
    got = [sorted(r["n"]) for r in tokenized(df, "t", "n").collect()]
    assert sorted(got) == sorted([sorted(["evil.com", "file", "t1059", "001", "2x"]), ["file"], []])


# --- chunks and sections -------------------------------------------------------------------------


def semantic(text, target, overlap):
    parts = re.split(r"(?<=[.!?])\s+", text.strip())
    out, now, size = [], [], 0
    for s in parts:
        if size + len(s) > target and now:
            out.append(" ".join(now))
            kept, total = [], 0
            for x in reversed(now):
                if total + len(x) > overlap:
                    break
                kept.insert(0, x)
                total += len(x)
            now, size = kept, total
        now.append(s)
        size += len(s)
    return [*out, " ".join(now)]


def test_semantic_chunks(spark):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abc ") for _ in range(rng.randint(1, 60))).strip() + rng.choice(".!?,") for _ in range(rng.randint(1, 30))) for _ in range(60)]
    df = spark.createDataFrame([(str(i), "otx", t, "m") for i, t in enumerate(texts)] + [("blank", "otx", " ", "m")], "id string, source string, content string, metadata string")
    got = {}
    for r in chunking.chunk(df, "semantic", 40, 10).orderBy("parent_doc_id", "chunk_index").collect():
        got.setdefault(r["parent_doc_id"], []).append(r["content"])
    for i, t in enumerate(texts):
        assert got[str(i)] == semantic(re.sub(r"[ \t]+", " ", t.strip()), 160, 40)
    assert "blank" not in got
    fixed = [r["content"] for r in chunking.chunk(df.where("id = '0'"), "fixed", 10, 4).orderBy("chunk_index").collect()]
    clean = re.sub(r"[ \t]+", " ", texts[0].strip())
    assert fixed == [clean[a : a + 40] for a in range(0, len(clean), 24)]
    with pytest.raises(ValueError):
        chunking.steps(F.col("x"), 4, 4)
    assert chunking.chunk(df.withColumn("source", F.lit("whois"))).count() == 60
    wide = [r["content"] for r in chunking.chunk(df.where("id = '0'"), "fixed", 10, 8).orderBy("chunk_index").collect()]
    assert wide == [clean[a : a + 40] for a in range(0, len(clean), 8)]


def merged(parts):
    out, parts = [], [list(p) for p in parts]
    for i, (t, page) in enumerate(parts):
        if len(t) < 200 and i + 1 < len(parts):
            parts[i + 1] = [t + " " + parts[i + 1][0], page]
        else:
            out.append((t, page))
    return out


def test_sections(spark):
    rng = random.Random(4)
    docs = {str(d): [("x" * rng.choice([100, 150, 199, 200, 300]), p) for p in range(rng.randint(1, 9))] for d in range(60)}
    df = spark.createDataFrame([(d, i, t, p) for d, ps in docs.items() for i, (t, p) in enumerate(ps)], "doc_id string, position int, text string, page int")
    got = {}
    for r in sections.merge_forward(df).orderBy("doc_id", "position").collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["page"]))
    assert got == {d: merged(p) for d, p in docs.items()}
    long = "y" * 120
    assert one(spark, long, lambda c: sections.keep(c, F.lit("Intro"))) and not one(spark, long, lambda c: sections.keep(c, F.lit(" Notes ")))
    assert not one(spark, " Page 3 of 9 " + "z" * 40, lambda c: sections.keep(c, F.lit(""))) and not one(spark, "a ..... " * 4 + long, lambda c: sections.keep(c, F.lit("")))
    assert one(spark, "\uf0a7a\t b\n 12 \n\n\n\nc\nPage 1 of 2 x\nPage 2 of 2", sections.clean_section) == "-a b\n\nc"
    elements = spark.createDataFrame([("d", 0, "Text", "w" * 60, 1), ("d", 1, "Title", "Head", 1), ("d", 2, "Text", "b" * 60, 2), ("d", 3, "Text", "c", 2), ("d", 4, "Title", "Empty", 3)], "doc_id string, position int, kind string, text string, page int")
    assert [tuple(r) for r in sections.titled_sections(elements).select("section_title", "page", "text").orderBy("page").collect()] == [("", 1, "w" * 60), ("Head", 1, "b" * 60 + "\nc")]


# --- retrieval -------------------------------------------------------------------------------------


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("a", "red fox fox"), ("b", "red dog"), ("c", "")], "chunk_id string, content string")
    index = plans.build_index(docs)
    idf = {t: math.log((3 - n + 0.5) / (n + 0.5) + 1) for t, n in {"red": 2, "fox": 1, "dog": 1}.items()}
    avg = 5 / 3
    weight = lambda t, tf, dl: idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    queries = spark.createDataFrame([(1, "Fox red red"), (2, "unknown")], "query_id int, text string")
    got = {(r["query_id"], r["chunk_id"]): (r["score"], r["rank"]) for r in plans.sparse_search(index, queries, 5).collect()}
    want = idf["fox"] * weight("fox", 2, 3) + idf["red"] * weight("red", 1, 3)
    assert set(got) == {(1, "a"), (1, "b")} and got[1, "a"] == (pytest.approx(want), 0) and got[1, "b"][1] == 1


def test_fusion(spark):
    rows = lambda ids: spark.createDataFrame([(1, c, r) for r, c in enumerate(ids)], "query_id int, chunk_id string, rank int")
    a, b = rows("xyz"), rows("yxw")
    got = [tuple(r) for r in retrieval.fuse([(a, 0.5), (b, 0.5)]).orderBy("rank").select("chunk_id", "score").collect()]
    assert [c for c, _ in got] == ["x", "y", "z", "w"] and got[0][1] == pytest.approx(0.5 / 61 + 0.5 / 62)
    assert [r["chunk_id"] for r in retrieval.fuse([(a, 0), (b, 1)]).orderBy("rank").collect()] == list("yxw")
    for bad in ([(a, -1)], [(a, 0)], []):
        with pytest.raises(ValueError):
            retrieval.fuse(bad)


def test_pipeline_and_answers(spark):
    docs = spark.createDataFrame([(f"c{i}", s, t, a) for i, (s, t, a) in enumerate([("mitre", "alpha beta gamma", "T1001"), ("mitre", "alpha beta", "T1001.002"), ("otx", "delta alpha", "T1003"), ("otx", "epsilon", None)])], "chunk_id string, source string, content string, attack_id string")
    embed = models.hashed_vector(16)
    docs = docs.withColumn("vector", embed(F.col("content")))
    index = plans.build_index(docs.withColumn("pulse_id", F.lit(None).cast("string")))
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "delta")], "query_id int, text string")
    best = {r["query_id"]: r["chunk_id"] for r in plans.build(index, "hybrid", Settings(), embed, retrieval.overlap_score).run(queries, 3).where("rank = 0").collect()}
    assert best == {1: "c1", 2: "c2"}
    only = plans.build(index, "dense", Settings(), embed).run(queries, 4, "otx").collect()
    assert {r["source"] for r in only} == {"otx"} and {r["retriever"] for r in only} == {"dense"}
    results = plans.build(index, "hybrid", Settings(reranker_enabled=False), embed).run(queries, 4)
    said = plans.annotate(queries, results, lambda p: F.lit("T1001, T9999 then T1001"), models.TECHNIQUE_PROMPT)
    assert {tuple(r["techniques"]) for r in said.collect()} == {("T1001", "T9999")}
    assert {r["actor"] for r in plans.attribute(queries, results, models.no_model, models.ACTOR_PROMPT).collect()} == {""}
    failed = plans.answer(queries, results, models.no_model, models.ANSWER_PROMPT)
    assert {r["answer"] for r in failed.collect()} == {models.FAILED} and plans.answered(failed).count() == 0
    messages = render.context_messages(queries, results, "sys").where("query_id = 2").first()["messages"]
    assert messages[0]["role"] == "system" and json.loads(messages[1]["content"])["query"] == "delta"
    assert render.candidate_lines(results).count() == 2
    assert one(spark, "a b c d e", lambda c: models.dense_text(c, lambda p: F.lit("made"))) == "made" and one(spark, "a b", lambda c: models.dense_text(c, lambda p: F.lit("made"))) == "a b"
    assert alpha("odd") == 0.5 and alpha("dense") == 1.0
    with pytest.raises(ValueError):
        Settings(hybrid_alpha=2)
    with pytest.raises(ValueError):
        Settings(hyde_enabled=True)


# --- evaluation -------------------------------------------------------------------------------------


def test_ranking_metrics_by_hand(spark):
    queries = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "query_id int, category string")
    results = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, True), (2, 0, True)], "query_id int, rank int, match boolean")
    rows = {(r["query_id"], r["k"]): r for r in metrics.per_query(results, queries, [1, 3]).collect()}
    assert rows[1, 1]["hit"] == 0 and rows[1, 3]["hit"] == 1 and rows[1, 1]["rr"] == 0.5 and rows[3, 3]["rr"] == 0
    assert rows[1, 3]["ndcg"] == pytest.approx(round(1 / math.log2(3) + 1 / math.log2(4), 4)) and rows[1, 3]["ndcg"] > 1
    all_ = {(r["category"], r["k"]): r for r in metrics.by_category(metrics.per_query(results, queries, [1, 3])).collect()}
    assert all_["overall", 3]["hit_rate"] == pytest.approx(2 / 3) and all_["p", 3]["hit_rate"] == 1 and all_["q", 3]["n_queries"] == 1
    assert [r["category"] for r in metrics.alerts(metrics.by_category(metrics.per_query(results, queries, [10]))).collect()] == ["overall"]


def test_set_metrics_and_recall(spark):
    rows = spark.createDataFrame([(["T1001.001", " t1002 "], ["T1001", "T1003", ""]), ([], ["T1"])], "gold array<string>, pred array<string>")
    r = metrics.micro(metrics.set_counts(rows, F.col("gold"), F.col("pred"))).first()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 2, 1) and r["f1"] == pytest.approx(2 / 5)
    assert metrics.micro(metrics.set_counts(rows.limit(0), F.col("gold"), F.col("pred"))).first()["f1"] == 0
    found = spark.createDataFrame([(1, 0, ""), (1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "query_id int, rank int, label string")
    assert {r["k"]: r["labels"] for r in metrics.prefixes(found, "label", [1, 2]).collect()} == {1: ["a"], 2: ["a", "b"]}
    assert [r["k"] for r in metrics.round_robin(spark.createDataFrame([("b", i) for i in range(3)] + [("a", 9)], "c string, k int"), "c", "k", 3).collect()] == [9, 0, 1]


def test_query_set_and_attribution(spark):
    queries = spark.createDataFrame(
        [(1, "precise", ["T1001"], [], [], ["x"], None, None), (2, "otx_malware", [], ["p1", "p2"], ["otx"], [], None, "m"), (3, "relationship_direct", ["T2"], [], [], [], "APT X", None), (4, "fuzzy", [], [], ["otx"], [], None, None)],
        "query_id int, category string, gold_attack_ids array<string>, gold_pulse_ids array<string>, gold_sources array<string>, expected_chunk_ids array<string>, gold_actor string, gold_malware string",
    )
    results = spark.createDataFrame(
        [(1, "x", 0, "T1001.003", None, "mitre", ""), (2, "y", 0, None, "p9", "otx", ""), (2, "z", 1, None, "p1", "otx", ""), (3, "x", 0, "T2", None, "mitre", "by apt y"), (3, "y", 1, "T2", None, "mitre", "by apt x"), (4, "q", 0, None, None, "otx", "")],
        "query_id int, chunk_id string, rank int, attack_id string, pulse_id string, source string, content string",
    )
    ranking, sets, recall = evaluation.attribution(results, queries, [1, 5])
    hits = {(r["category"], r["k"]): r["hit_rate"] for r in ranking.collect()}
    assert hits["precise", 1] == 1 and hits["otx_malware", 1] == 0 and hits["otx_malware", 5] == 1 and hits["relationship_direct", 1] == 0 and hits["fuzzy", 1] == 1
    assert {(r["category"], r["k"]): r["f1"] for r in sets.collect()}["precise", 1] == 1
    assert {r["k"]: r["recall"] for r in recall.collect()} == {1: 0, 5: 0.5}
    assert {(r["category"], r["k"]): r["hit_rate"] for r in evaluation.query_set(results, queries, [1]).collect()}["precise", 1] == 1


def test_actors(spark):
    table = lambda rows: spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "name string, others array<string>, position int")
    aliases = graph.actor_edges(table([("A", ["b"]), ("b ", ["C"]), ("a", ["B"])]), "alias")
    related = graph.actor_edges(table([("c", ["D"])]), "related")
    names = ["a", "B", "c", "d", "lone", None]
    pairs = spark.createDataFrame([(x, y) for x in names for y in names], "a string, b string")
    got = {(r["a"], r["b"]): r["verdict"] for r in graph.actor_verdicts(pairs, aliases, related).collect()}
    assert got["a", "c"] == got["a", "a"] == "C" and got["a", "d"] == got["d", "d"] == "P" and got["lone", "lone"] == got[None, "a"] == "I"
    share = metrics.verdict_shares(spark.createDataFrame([(v,) for v in "CCPI"], "verdict string")).first()
    assert share["correct"] == 0.5 and share["plausible_pct"] == 75


# --- sources -----------------------------------------------------------------------------------------


def test_stix(spark, tmp_path):
    ref = lambda x: [{"source_name": "mitre-attack", "external_id": x}]
    objects = [
        {"type": "attack-pattern", "id": "ap--1", "name": "Phish", "description": " d ", "external_references": ref("T1566"), "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "initial-access"}]},
        {"type": "attack-pattern", "id": "ap--2", "name": "Old", "revoked": True, "external_references": ref("T1")},
        {"type": "intrusion-set", "id": "is--1", "name": "APT X", "aliases": ["X", "Bear"]}, {"type": "malware", "id": "m--1", "name": "Mal"}, {"type": "campaign", "id": "c--1", "name": "Op"},
        {"type": "relationship", "id": "r--1", "relationship_type": "uses", "source_ref": "is--1", "target_ref": "ap--1", "description": "text"},
        {"type": "relationship", "id": "r--2", "relationship_type": "uses", "source_ref": "is--1", "target_ref": "gone"},
        {"type": "relationship", "id": "r--3", "relationship_type": "uses", "source_ref": "m--1", "target_ref": "ap--1"},
        {"type": "relationship", "id": "r--4", "relationship_type": "attributed-to", "source_ref": "c--1", "target_ref": "is--1"},
        {"type": "relationship", "id": "r--5", "relationship_type": "uses", "source_ref": "is--1", "target_ref": "m--1", "revoked": True},
    ]
    (tmp_path / "b.json").write_text(json.dumps({"objects": objects}))
    rows = stix.read_objects(spark, f"{tmp_path}/b.json")
    assert [(r["attack_id"], r["content"]) for r in stix.techniques(rows).collect()] == [("T1566", "T1566: Phish\nTactics: initial-access\n\nd")]
    watch = Observation("edges")
    got = sorted(r["content"] for r in stix.relationships(rows, watch).collect())
    assert got == ["APT X uses Phish (T1566)\n\ntext", "Op attributed-to APT X"] and watch.get["skipped"] == 1
    nodes, edges = stix.nodes(rows), stix.edges(rows)
    actors = spark.createDataFrame([("is--1", "initial-access"), ("is--1", "other")], "actor string, tactic string")
    assert [tuple(r) for r in graph.gold_techniques(actors, nodes, edges).collect()] == [("is--1", "initial-access", "T1566", True, True)]
    match = {r["query"]: (r["id"], r["mode"]) for r in graph.match_names(spark.createDataFrame([("apt x",), ("bear",), ("bea",), ("zz",)], "query string"), nodes.where("type = 'intrusion-set'")).collect()}
    assert match == {"apt x": ("is--1", "exact_name"), "bear": ("is--1", "exact_alias"), "bea": ("is--1", "alias_contains"), "zz": (None, "no_match")}
    assert {r["type"]: r["n"] for r in graph.node_statistics(nodes).collect()}[None] == 5


def test_feeds(spark):
    pulse = spark.read.schema(feeds.PULSE).json(spark.sparkContext.parallelize([json.dumps({"id": "1", "name": "N", "description": " D ", "adversary": "A", "malware_families": ["F", {"display_name": "G"}, ""], "targeted_countries": ["DE"], "indicators": [{"indicator": f"i{n}"} for n in range(25)]}), json.dumps({"id": "2"})]))
    rows = {r["pulse_id"]: r for r in feeds.pulses(pulse).collect()}
    assert set(rows) == {"1"} and rows["1"]["content"].startswith("N\n\nD\n\nAttributed to A.\n\nAssociated malware: F, G.\n\nTargeted countries: DE.\n\nKey indicators: i0, ") and "i20" not in rows["1"]["content"]
    payload = {"status": 1, "domain_name": " Example.COM ", "create_date": "2020", "domain_registrar": {"iana_id": "7", "registrar_name": "R"}, "name_servers": ["n1", "n2"]}
    live = spark.read.schema(feeds.WHOXY_RECORD).json(spark.sparkContext.parallelize([json.dumps(payload), json.dumps({"status": 0})]))
    assert [r["content"] for r in feeds.whois(feeds.whois_lookups(live)).collect()] == ["Domain example.com is registered with R (IANA ID: 7). It was created on 2020. Name servers: n1, n2."]
    record = feeds.WHOXY_RECORD.replace(" ", ":").replace(",:", ",")
    history = spark.read.schema(f"status int, domain_name string, whois_records array<struct<{record},query_time:string>>").json(
        spark.sparkContext.parallelize([json.dumps({"status": 1, "domain_name": "e.com", "whois_records": [{"query_time": "2022", "create_date": "a"}, {"query_time": "2024", "create_date": "b"}]})])
    )
    assert [(r["domain"], r["created"]) for r in feeds.whois_history(history).collect()] == [("e.com", "b")]
    dns = spark.read.schema(feeds.PDNS).json(spark.sparkContext.parallelize([json.dumps({"domain": "d.e", "first_seen": "1", "last_seen": "2", "resolutions": [{"ip": "1.1.1.1", "asn": "AS1", "asn_name": "X", "first_seen": "a", "last_seen": "b"}, {"ip": "2.2.2.2"}], "subdomains": ["s"]}), "{}"]))
    assert [r["content"] for r in feeds.passive_dns(dns).collect()] == ["Passive DNS history for domain d.e. Observed from 1 to 2. IP resolutions: 1.1.1.1 (AS1 / X) seen a to b; 2.2.2.2. Known subdomains: s."]
    scan = spark.read.schema(feeds.SCAN).json(spark.sparkContext.parallelize([json.dumps({"data": {"id": "v.e", "attributes": {"last_analysis_stats": {"malicious": 5, "harmless": 65, "x": 3}, "tags": ["t"], "crowdsourced_yara_results": [{"rule_name": "r"}], "last_modification_date": 1717200000}}}), "{}"]))
    got = feeds.scans(scan).collect()
    assert [r["content"] for r in got] == ["VirusTotal analysis of domain v.e. Detection: 5 malicious, 0 suspicious, 65 harmless out of 73 engines. Matched YARA rules: r. Tags: t."]
    assert json.loads(got[0]["metadata"])["last_modified"] == "2024-06-01T00:00:00+00:00"


def test_files_and_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), "otx", f"Text {i}. More.") for i in range(3)], "id string, source string, content string")
    n = ingest.seed(docs.withColumn("retrieved_at", F.lit("2026-01-01T00:00:00")), f"{tmp_path}/c", limit=2)
    assert n == {"documents": 2, "chunks": 2}
    with open(f"{tmp_path}/c/part-bad.json", "w") as f:
        f.write('{"id": "x"}\nnot json\n')
    good, skipped = files.chunks(spark, f"{tmp_path}/c")
    assert good.count() == 2 and skipped.count() == 2
    points = f"{tmp_path}/points"
    assert ingest.load(spark, {"otx": f"{tmp_path}/c", "none": f"{tmp_path}/absent"}, points) == {"otx": 2, "none": 0}
    ingest.seed(docs.withColumn("retrieved_at", F.lit("2026-01-01T00:00:00")).withColumn("content", F.concat(F.lit("New "), "content")), f"{tmp_path}/c2", limit=1)
    assert ingest.load(spark, {"otx": f"{tmp_path}/c2"}, points) == {"otx": 1}
    assert sorted(r["content"] for r in versioned.read(spark, points).collect()) == ["New Text 0. More.", "Text 1. More."]
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k int, v string, seq int")
    spark.sql("DROP TABLE IF EXISTS kv")
    upsert_table(rows, "kv", ["k"])
    upsert_table(spark.createDataFrame([(1, "c", 1), (2, "d", 1)], "k int, v string, seq int"), "kv", ["k"])
    assert sorted(map(tuple, spark.table("kv").collect())) == [(1, "c"), (2, "d")]
    spark.sql("DROP TABLE kv")
    append_log(spark.createDataFrame([("p", "error", 0, "e")], "pulse_id string, status string, chunks int, error string").coalesce(1), f"{tmp_path}/log")
    assert files.checkpoint(spark, f"{tmp_path}/log").first()["status"] == "error"
    (tmp_path / "q.jsonl").write_text('{"query_id": "1", "query": "x", "category": "precise", "gold_pulse_id": ["a", ""]}\n{"query_id": "2", "query": "y", "category": "odd", "gold_pulse_id": "b"}\n')
    assert {r["query_id"]: r["gold_pulse_ids"] for r in files.query_set(spark, f"{tmp_path}/q.jsonl").collect()} == {"1": ["a"], "2": ["b"]}
    with pytest.raises(Exception, match="unknown category odd"):
        files.query_set(spark, f"{tmp_path}/q.jsonl", strict=True).collect()
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text("1\n2\n")
    (tmp_path / "d.txt").write_text("# c\n\nx.e\ny.e\nx.e\n1\n")
    assert {(r["text"], r["gold"]) for r in files.paired(spark, f"{tmp_path}/a.txt", f"{tmp_path}/b.txt").collect()} == {("one", "1"), ("two", "2")}
    with pytest.raises(Exception, match="different lengths"):
        files.paired(spark, f"{tmp_path}/a.txt", f"{tmp_path}/d.txt").collect()
    assert [r["domain"] for r in files.domain_list(spark, f"{tmp_path}/d.txt", ["y.e"]).collect()] == ["y.e", "x.e", "1"]
    (tmp_path / "actors.json").write_text('{"A": ["b"], "c": []}')
    assert files.actor_table(spark, f"{tmp_path}/actors.json").count() == 2
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "x.pdf").write_bytes(b"ok")
    (tmp_path / "r" / "y.pdf").write_bytes(b"bad")

    def parser(raw):
        if raw == b"bad":
            raise ValueError
        return [("T", 1, "s" * 150), ("U", 2, "t" * 250), ("Notes", 3, "n" * 300)]

    assert [r["content"] for r in files.reports(spark, f"{tmp_path}/r", parser).collect()] == ["s" * 150 + " " + "t" * 250]
    assert markdown(rows.orderBy("seq").limit(1)).splitlines()[2] == "| 1 | a | 1 |"
    assert splice("a <!-- t:start -->x<!-- t:end --> b", "new", "t") == "a <!-- t:start -->\nnew\n<!-- t:end --> b"
    write_chunks(docs, f"{tmp_path}/w")
    assert keyed.pending(docs, docs.limit(0), "id").count() == 3


def test_http_retries_and_pages(monkeypatch):
    tries = []

    def open_(request, timeout):
        tries.append(request.full_url)
        raise OSError

    monkeypatch.setattr(http.urllib.request, "urlopen", open_)
    assert http.fetch("http://x.example/", sleep=lambda s: None) == (0, None) and len(tries) == 3
    assert http.retryable(429) and http.retryable(503) and not http.retryable(404)
    store = {"u1": {"results": [{"id": 1}, {"id": 2}], "next": "u2"}, "u2": {"results": [{"id": 2}], "next": "u1"}}
    assert [r["id"] for r in http.pages("u1", lambda u: (200, json.dumps(store[u])))] == [1, 2]


# --- command line ----------------------------------------------------------------------------------


def test_command_line(spark, tmp_path, capsys):
    from fathom import cli

    with open(f"{tmp_path}/w.json", "w") as f:
        f.writelines(json.dumps({"domain": f"d{i}.example", "registrar": r}) + "\n" for i, r in enumerate(("Alpha", "Beta", "Gamma")))
    points = f"{tmp_path}/points"
    assert cli.main(["seed", "whois", f"{tmp_path}/w.json", f"{tmp_path}/c", "--limit", "3"]) == 0
    rows = spark.read.schema(files.CHUNK).json(f"{tmp_path}/c")
    assert rows.count() == 3
    assert cli.main(["ingest", f"whois={tmp_path}/c", "--table", points, "--model", f"{tmp_path}/m"]) == 0
    capsys.readouterr()
    assert cli.main(["query", "registered with Beta", "-k", "1", "--table", points, "--model", f"{tmp_path}/m"]) == 0
    assert "d1.example" in capsys.readouterr().out
    (tmp_path / "q.jsonl").write_text(json.dumps({"query_id": "1", "query": "Beta", "category": "fuzzy", "gold_sources": ["whois"]}))
    assert cli.main(["eval", "retrieval", f"{tmp_path}/q.jsonl", "-c", "hybrid", "-k", "10", "-o", f"{tmp_path}/e.json", "--table", points, "--model", f"{tmp_path}/m"]) == 0
    assert cli.main(["metrics", f"{tmp_path}/e.json", "--strict"]) == 0
    saved = json.loads((tmp_path / "e.json").read_text())
    for r in saved:
        r["hit_rate"] = 0.1
    (tmp_path / "e.json").write_text(json.dumps(saved))
    assert cli.main(["metrics", f"{tmp_path}/e.json", "--strict"]) == 1 and cli.main(["metrics", f"{tmp_path}/e.json"]) == 0
