"""Lookups by grams and by automaton beside plain containment."""

import random

import pytest

from fathom.operators import graph
from fathom.operators.substrings import contained, mentions


def test_contained_equals_a_theta_join_without_one(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    hay = [word(rng.randint(0, 12)) for _ in range(300)] + [None, "", "a", "ab", "x.*y"]
    needles = [word(rng.randint(1, 5)) for _ in range(120)] + [None, "", "zzz", ".*", "x.*y", "aaaaaaaaaaaaaaaaaaaa"]
    df = contained(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(h,) for h in hay], "text string"))
    assert sorted(map(tuple, df.collect())) == sorted((n, h) for n in {n for n in needles if n} for h in {h for h in hay if h is not None} if n in h)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_names_are_matched_without_a_nested_loop(spark):
    names = spark.createDataFrame([(1, "Alpha", ["red fox"], 1), (2, "Beta", ["fox trot", None], 2), (3, None, None, 3)], "id int, name string, aliases array<string>, position int")
    df = graph.match_names(spark.createDataFrame([("trot",), ("FOX",), ("d f",), ("alpha ",), ("",), (None,), ("q",)], "query string"), names)
    assert {r["query"]: (r["id"], r["mode"]) for r in df.collect()} == {"trot": (2, "alias_contains"), "FOX": (None, "alias_ambiguous"), "d f": (1, "alias_contains"), "alpha ": (1, "exact_name"), "": (None, "no_match"), None: (None, "no_match"), "q": (None, "no_match")}
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_mentions_equal_containment(spark, most):
    docs = [(1, "The Red FOX ran"), (2, "redfoxtrot"), (3, None), (4, ""), (5, "a fo x"), (6, "ÉCLAIR fox fox"), (6, "other")]
    names = [(10, " Fox "), (10, "red"), (11, "trot"), (12, "éclair"), (13, ""), (14, None), (15, "absent"), (16, "fox")]
    df = mentions(spark.createDataFrame(docs, "chunk_id int, content string"), spark.createDataFrame(names, "id int, name string"), most=most)
    want = {(k, i) for k, t in docs for i, n in names if t and n and n.strip() and n.strip().lower() in t.lower()}
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert mentions(spark.createDataFrame(docs, "chunk_id int, content string"), spark.createDataFrame([], "id int, name string"), most=most).collect() == []


def test_no_join_of_names_sends_a_side_to_all_tasks(spark):
    """Only grams, which an alphabet bounds, may go to all tasks."""
    names = spark.createDataFrame([(i, f"name {i}", [f"mail{i}@x.org"], i) for i in range(300)], "id int, name string, aliases array<string>, position int")
    df = graph.match_names(spark.createDataFrame([(q,) for i in range(0, 300, 7) for q in (f"NAME {i}", f"mail{i}@X.org", f"ail{i}@", f"z{i}")] + [("mail2",)], "query string"), names)
    found = {r["query"]: (r["id"], r["mode"]) for r in df.collect()}
    assert [found[q] for q in ("NAME 7", "mail7@X.org", "ail294@", "mail2", "z7")] == [(7, "exact_name"), (7, "exact_alias"), (294, "alias_contains"), (None, "alias_ambiguous"), (None, "no_match")]
    joins = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]
    assert all("[gram#" in line for line in joins), joins
