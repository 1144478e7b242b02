"""The inverted file beside exact search: exact mode in every row, probes by recall, odd vectors."""

import numpy as np
import pytest

from fathom.operators import neighbours as N
from fathom.operators import retrieval as R
from fathom.sinks import new_folder

SCHEMA = "chunk_id long, vector array<float>"


def ranked(scores, k=7):
    return sorted((r["query_id"], r["chunk_id"], r["rank"], round(r["score"], 7)) for r in R.ranked(scores, k).collect())


@pytest.fixture(scope="module")
def data(spark):
    """Clusters, a vector that stands 200 times in the table, opposite ones, zeros, other lengths and nulls."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    m = np.concatenate([c + 0.4 * rng.normal(size=(60, 16)) for c in centres])
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(1000 + i, m[0].tolist()) for i in range(200)]
    rows += [(2000, [0.0] * 16), (2001, [0.0] * 16), (2002, [1.0] * 15), (2003, None), (2004, []), (2005, (-m[1]).tolist()), (2006, (m[2] * 1e6).tolist())]
    asked = [(int(i), m[i].tolist()) for i in range(0, len(m), 31)] + [(5000, rng.normal(size=16).tolist()), (5001, [0.0] * 16), (5002, [1.0] * 3), (5003, None)]
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(4)
    queries = spark.createDataFrame(asked, "query_id long, vector array<float>")
    return vectors, queries, N.build(vectors, new_folder(spark, "cells"))


@pytest.mark.parametrize("part, block", [(65_536, 4096), (50, 3)])
def test_exact_mode_equals_full_search(data, monkeypatch, part, block):
    vectors, queries, index = data
    monkeypatch.setattr(N, "PART", part)
    monkeypatch.setattr(N, "BLOCK", block)
    want = ranked(R.dense_scores(queries, vectors.where("size(vector) = 16"), 7))
    assert ranked(N.search(index, queries, 7, probes=2, exact=True)) == [r for r in want if r[0] not in (5002, 5003)]


def test_every_vector_is_in_one_cell_and_probes_read_few(spark, data):
    vectors, queries, index = data
    rows = index.rows()
    assert rows.count() == vectors.where("size(vector) = 16").count() == index.sizes.sum()
    assert rows.where("cell = -1").count() == 2
    plan = index.rows([1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    want = {r[:2] for r in ranked(R.dense_scores(queries, vectors.where("size(vector) = 16"), 10), 10) if r[0] < 5000}
    got = {r[:2] for r in ranked(N.search(index, queries, 10, probes=6), 10)}
    assert len(want & got) >= 0.9 * len(want)


def test_a_loaded_index_is_the_same(spark, data):
    _, queries, index = data
    again = N.load(spark, index.path)
    assert np.allclose(again.centres, index.centres) and (again.sizes == index.sizes).all()
    assert ranked(N.search(again, queries, 3, probes=3), 3) == ranked(N.search(index, queries, 3, probes=3), 3)


def test_few_vectors_and_none(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    none = N.build(spark.createDataFrame([], SCHEMA), new_folder(spark, "cells"))
    assert N.search(none, queries, 3).collect() == []
    two = N.build(spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 0.0])], SCHEMA), new_folder(spark, "cells"), cells=5)
    assert ranked(N.search(two, queries, 3, exact=True), 3) == [(1, 1, 0, 0.7071068), (1, 2, 1, 0.0)]
    zeros = N.build(spark.createDataFrame([(2, [0.0, 0.0])], SCHEMA), new_folder(spark, "cells"))
    assert ranked(N.search(zeros, queries, 3, exact=True), 3) == [(1, 2, 0, 0.0)]


def test_more_queries_than_a_task_holds(data, monkeypatch):
    """Beyond QUERY_BLOCK queries meet the vectors as a grid; the scores are those of the matrix."""
    vectors, queries, _ = data
    want = ranked(R.dense_scores(queries, vectors, 7))
    monkeypatch.setattr(R, "QUERY_BLOCK", 5)
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "PART", 100)
    assert ranked(R.dense_scores(queries, vectors, 7)) == want
