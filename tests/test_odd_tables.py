"""Queries beside their SQL on tables that the given ones are not like: equal URLs, folders of files, far years, vectors without clusters."""

import os

import duckdb
import numpy as np
from pyspark.sql import functions as F

from fathom import catalog
from fathom.functions.text import iso_from_epoch
from fathom.operators import retrieval as R
from fathom.plans import retrieval as plans

SF = "/root/testdata/sf0.001"


def same(spark, folder, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in os.listdir(folder):
        at = f"{folder}/{t}"
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{at}/*.parquet')" if os.path.isdir(at) else f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{at}')")
    rel = con.sql(catalog.oracle_sql()[name])
    got = sorted((tuple(r) for r in catalog.queries()[name](spark, str(folder)).select(*rel.columns).collect()), key=repr)
    assert got and got == sorted(rel.fetchall(), key=repr)


def test_report_links_of_pages_with_one_url(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/pages.parquet")
    rows.unionByName(rows.withColumn("page_id", F.col("page_id") + 10_000)).write.parquet(f"{tmp_path}/pages.parquet")
    same(spark, tmp_path, "report_links")


def test_streams_read_a_table_that_is_a_folder(spark, tmp_path):
    for t in ("clicks", "events"):
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
    same(spark, tmp_path, "stream_expiry")
    same(spark, tmp_path, "stream_dedupe")


def test_years_of_five_digits_have_no_sign(spark):
    days = spark.createDataFrame([(d * 86400,) for d in (1, 2_932_896, 2_932_897, 6_000_000)], "s long")
    assert [r[0] for r in days.select(iso_from_epoch(F.col("s"))).collect()] == [f"{y}T00:00:00+00:00" for y in ("1970-01-02", "9999-12-31", "10000-01-01", "18397-06-11")]


def test_probes_reach_the_recall_without_clusters(spark, tmp_path):
    m = np.random.default_rng(5).normal(size=(1500, 48))
    spark.createDataFrame([(i, v.tolist(), i % 10) for i, v in enumerate(m)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    same(spark, tmp_path, "cells_recall")


def test_many_queries_are_scored_in_tiles(spark, monkeypatch):
    m = np.random.default_rng(6).normal(size=(300, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "chunk_id long, vector array<float>").coalesce(2)
    asked = rows.where("chunk_id % 3 = 0").withColumnRenamed("chunk_id", "query_id")
    unit = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(float)
    want = [(q, int(c)) for q in range(0, 300, 3) for c in sorted(np.argsort(-(unit @ unit[q]), kind="stable")[:5])]
    monkeypatch.setattr(R, "TOGETHER", 400)
    for most in (4096, 10):  # queries sent to the tasks, and the grid
        monkeypatch.setattr(R, "QUERY_BLOCK", most)
        got = R.ranked(R.dense_scores(asked, rows, 5), 5)
        assert sorted((r["query_id"], r["chunk_id"]) for r in got.collect()) == want


def test_pulses_are_dealt_to_all_cores(spark):
    plan = catalog.queries()["pulse_documents"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan


def test_postings_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(plans, "POSTINGS", 10)
    docs = spark.createDataFrame([(i, "alpha beta " * (1 + i % 3) + f"only{i}") for i in range(100)], "chunk_id long, content string")
    asked = spark.createDataFrame([(1, "alpha only7"), (2, "only9")], "query_id long, text string")
    index = plans.build_index(docs, asked)
    found = plans.sparse_search(index, asked, 1)
    assert index.parts == 21  # 102 counts of terms that are asked for and 100 of whole documents, by tens
    assert f", {index.parts})" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["query_id"], r["chunk_id"]) for r in found.collect()) == [(1, 7), (2, 9)]
