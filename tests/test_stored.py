"""Stored postings beside full products, and versioned tables through failures and replays."""

import os

import pytest
from pyspark.sql import functions as F

from fathom.operators import blocks
from fathom.operators import retrieval as R
from fathom.plans import retrieval as plans
from fathom.sinks import store, versioned
from fathom.streaming import upsert_into


@pytest.fixture(scope="module")
def corpus(spark):
    import random

    rng = random.Random(6)
    words = [f"word{i}" for i in range(60)]
    weight = [1 / (i + 1) for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, weight, k=rng.choice([3, 10, 40, 200])))) for i in range(900)] + [(900, None), (901, ""), (902, "word0 word1"), (903, "word0 word1")]
    return spark.createDataFrame(rows, "chunk_id long, content string").repartition(3)


def test_blocks_give_the_full_products(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "SHARD", 16)
    asked = spark.createDataFrame([(1, "word0 word1"), (2, "word59 word0 word40"), (3, "nothing known"), (4, None), (5, "word58"), (6, " ".join(f"word{i}" for i in range(50)))], "query_id long, text string")
    index = blocks.build(corpus, str(tmp_path))
    full = R.ranked(R.sparse_scores(R.query_terms(asked, plans.build_index(corpus).terms), plans.build_index(corpus).weights), 7)
    found = blocks.search(index, asked, 7)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 8)) for r in df.collect())
    assert rows(found.results) == rows(full) and len(rows(full)) > 20
    read = {r["query_id"]: (r["shards"], r["read"]) for r in found.read.collect()}
    assert all(n <= m for m, n in read.values()) and read[1][1] < 0.7 * read[1][0]
    assert index.blocks.agg(F.max(F.size("keys"))).first()[0] <= 16
    again = blocks.load(spark, str(tmp_path))
    assert rows(blocks.search(again, asked, 7).results) == rows(full)


def kv(spark, *rows, schema="k int, v string"):
    return spark.createDataFrame(list(rows), schema)


def read(spark, path, number=None):
    return sorted(map(tuple, versioned.read(spark, path, number).collect()), key=repr)


def files_of(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def test_only_touched_buckets_are_written_and_old_versions_stay(spark, tmp_path):
    path = f"{tmp_path}/t"
    first = versioned.upsert(kv(spark, *[(i, f"a{i}") for i in range(100)], (None, "none")), path, ["k"], buckets=8)
    before = files_of(path)
    second = versioned.upsert(kv(spark, (3, "b3", 1), (3, "c3", 2), (500, "new", 1), (4, "a4", 1), schema="k int, v string, seq int"), path, ["k"])
    assert (first.number, second.number) == (0, 1)
    kept = [b for b in first.files if second.files[b] == first.files[b]]
    assert len(kept) >= 6 and before.items() <= files_of(path).items()
    assert dict(read(spark, path))[3] == "c3" and dict(read(spark, path))[500] == "new" and len(read(spark, path)) == 102
    assert dict(read(spark, path, 0))[3] == "a3" and len(read(spark, path, 0)) == 101
    assert versioned.upsert(kv(spark, (3, "c3"), (None, "none")), path, ["k"]).number == 1  # nothing new: no version
    with pytest.raises(ValueError, match="has keys"):
        versioned.upsert(kv(spark, (3, "x"), schema="k int, w string"), path, ["k"])
    gone = versioned.vacuum(spark, path, last=1)
    assert gone == [] and read(spark, path)[0]  # the first write's folder still holds untouched buckets
    with pytest.raises(FileNotFoundError):
        versioned.read(spark, path, 0)


def test_a_failure_before_the_manifest_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    versioned.upsert(kv(spark, (1, "a"), (2, "b")), path, ["k"], buckets=2)
    real = store.put_new
    monkeypatch.setattr(store, "put_new", lambda *a: (_ for _ in ()).throw(OSError("cut off")))
    with pytest.raises(OSError, match="cut off"):
        versioned.upsert(kv(spark, (1, "c"), (3, "d")), path, ["k"])
    assert read(spark, path) == [(1, "a"), (2, "b")]
    monkeypatch.setattr(store, "put_new", real)
    versioned.upsert(kv(spark, (1, "c"), (3, "d")), path, ["k"])
    assert read(spark, path) == [(1, "c"), (2, "b"), (3, "d")]
    assert len(versioned.vacuum(spark, path, last=1)) >= 1 and read(spark, path) == [(1, "c"), (2, "b"), (3, "d")]


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    at = versioned.upsert(kv(spark, (1, "a")), path, ["k"], buckets=2)
    versioned.upsert(kv(spark, (1, "b")), path, ["k"])
    monkeypatch.setattr(versioned, "version", lambda *a: at)
    with pytest.raises(versioned.Conflict):
        versioned.upsert(kv(spark, (1, "c")), path, ["k"])
    monkeypatch.undo()
    assert read(spark, path) == [(1, "b")]


def test_batches_of_a_stream_that_are_replayed(spark, tmp_path):
    path, source, schema = f"{tmp_path}/t", f"{tmp_path}/in", "k int, v string, seq int"
    kv(spark, (1, "a", 1), (2, "b", 1), schema=schema).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    upsert_into(stream(), path, ["k"], f"{tmp_path}/log")
    kv(spark, (2, "c", 2), (3, "d", 1), schema=schema).coalesce(1).write.mode("append").parquet(source)
    upsert_into(stream(), path, ["k"], f"{tmp_path}/log")
    assert read(spark, path) == [(1, "a"), (2, "c"), (3, "d")]
    at = versioned.version(spark, path)
    assert at.applied == {f"{tmp_path}/log": 1}
    assert versioned.upsert(kv(spark, (9, "late")), path, ["k"], batch=(f"{tmp_path}/log", 1)) == at
