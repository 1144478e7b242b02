"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import random

import corpus_pipeline
import pytest

from fathom.llm import bpe, decontaminate, media, ngram_join, pii, quality, suffix_dedup, toxicity, url_filters, warc
from fathom.llm._storage import discard, kept, renamed, salted_join

#: Extra columns named as what operators call their own.
CLASH = ["p_keep", "expected_grade", "_text", "matches", "_best", "component_id", "n_shingles", "_row", "n", "ids", "_key", "score", "media", "digest"]
RNG = random.Random(12)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 8))) for _ in range(500)]
LONG = " ".join(RNG.choice(WORDS) for _ in range(60_000))
prose = lambda n: " ".join(RNG.choice(WORDS) for _ in range(n))


def table(spark, texts, extra=CLASH):
    rows = [(i, t, "en", "s", len(t) if t else None, *[f"{c}{i}" for c in extra]) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in extra))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("edges")
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, "the only item of the benchmark, long enough"), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_every_stage_keeps_clashing_columns(spark, folder):
    texts = [(i, prose(30) if i % 2 else prose(30).replace(" ", "$$ ")) for i in range(40)]
    texts += [(100, None), (101, ""), (None, prose(20)), (102, LONG), (103, "a.b@c.example.com " + prose(30)), (104, prose(12)), (104, prose(13))]
    docs = table(spark, texts)
    docs = docs.unionByName(docs.where("doc_id IN (1, 104)"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r["matches"] == f"matches{r['doc_id']}" and r["p_keep"] == f"p_keep{r['doc_id']}" and r["_text"] == f"_text{r['doc_id']}" for r in rows), name
        ids = sorted((r["doc_id"] for r in rows), key=repr)
        if name in ("decontaminate", "pii"):
            assert len(ids) == docs.count()
        if name == "ngram_jaccard":
            assert ids.count(1) == 1 and ids.count(104) == 2 and {100, 101, 102, None} <= set(ids)
        if name == "pii":
            by = {r["doc_id"]: r["text"] for r in rows}
            assert by[100] is None and by[101] == "" and by[102] == LONG and by[103].startswith("<EMAIL> ")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_every_stage_takes_an_empty_table(spark, folder):
    none = table(spark, [(0, "x")]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).collect() == [], name


def test_pipeline_over_odd_rows(spark, folder):
    texts = [(i, prose(40) if i % 2 else prose(40).replace(" ", "$$ ")) for i in range(40)] + [(100, None), (101, ""), (102, LONG), (3, None)]
    table(spark, texts, []).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()}
    assert {i for i in range(40) if i % 2} | {102} <= got and not got & {i for i in range(40) if i % 2 == 0}


@pytest.mark.parametrize("order", [1, -1])
def test_an_id_that_stands_for_no_class_links_two(spark, order):
    a, b = prose(30), prose(30)
    rows = [(2, a), (3, b), (5, a), (5, b), (9, prose(30))][::order]
    got = {tuple(r) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()}
    assert got == {(2, 2), (3, 2), (5, 2), (9, 9)}


def test_operators_take_long_null_and_empty_texts(spark):
    docs = table(spark, [(0, None), (1, ""), (2, LONG), (3, LONG), (4, "short")])
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs).collect()} == {0: 0, 1: 1, 2: 2, 3: 2, 4: 4}
    cut = {r["doc_id"]: r for r in suffix_dedup.dedup(docs).collect()}
    assert cut[2]["n_removed"] == cut[3]["n_removed"] == len(LONG) and cut[0]["n_removed"] == cut[1]["n_removed"] == cut[4]["n_removed"] == 0
    assert {r["doc_id"]: r["contaminated"] for r in decontaminate.matched(docs, spark.createDataFrame([(7, LONG[-3000:-2000])], "item_id long, text string")).selectExpr("doc_id", "size(matches) > 0 AS contaminated").collect()} == {0: False, 1: False, 2: True, 3: True, 4: False}
    labels = spark.createDataFrame([(2, 1), (4, 0), (None, 1), (77, 0)], "doc_id long, quality int")
    assert quality.score(docs, quality.train(docs, labels)).count() == 5
    assert pii.find(docs).where("spans <> ''").count() == 0
    assert media.described(media.load(media.store(docs))).where("feature IS NOT NULL").count() == 5
    pages = spark.createDataFrame([(1, "http://a/", LONG), (2, None, LONG), (3, "", None)], "page_id long, url string, html string")
    got = {tuple(r) for r in warc.read(warc.look_up(warc.url_keys(pages), warc.build_index(warc.write(pages)))).select("page_id", "record_type").collect()}
    assert got == {(1, "response"), (2, "revisit"), (3, "response")}
    long_url = "http://example.com/en/" + "a/" * 50_000
    urls = spark.createDataFrame([(1, long_url, "k"), (2, None, "k"), (3, "", "k")], "page_id long, url string, _best string")
    judged = url_filters.judge(urls, [url_filters.site_rule("block", "com/en/")], [])
    assert {r["page_id"]: (r["verdict"], r["_best"]) for r in judged.collect()} == {1: ("block", "k"), 2: ("allow", "k"), 3: ("allow", "k")}


def test_models_take_empty_tables(spark):
    none, labels = table(spark, [(0, "x")]).limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(none, quality.train(none, labels)).collect() == []
    assert toxicity.score(none, toxicity.train(none, labels)).collect() == []
    docs = table(spark, [(1, "a b"), (1, "a b"), (2, None)])
    assert [r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()] == [0.5] * 3
    assert suffix_dedup.dedup(none).collect() == bpe.encode(none, "unused", "x").collect() == []


def test_salted_join_equals_a_join(spark):
    many = spark.createDataFrame([(k, i) for k in range(6) for i in range(1 if k else 500)], "k long, i long")
    one = many.groupBy("k").count().withColumnRenamed("count", "n")
    for hot in (1, 7, 100_000):
        assert sorted(map(tuple, salted_join(many, one, "k", ["i"], hot=hot).select("k", "i", "n").collect())) == sorted(map(tuple, many.join(one, "k").select("k", "i", "n").collect()))


def test_tables_go_when_told(spark):
    df = kept(spark.range(3), "gone")
    path = df.kept_at
    discard(df, None, spark.range(2))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    inner, back = renamed(spark.createDataFrame([(1, "x", 2)], "doc_id long, text string, Text_ int"), ("text",))
    assert inner.columns == ["_extra_0", "text", "_extra_2"] and back(inner).columns == ["doc_id", "text", "Text_"]
