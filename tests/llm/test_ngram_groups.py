"""Rows that share an id in open groups."""

import pytest
from pyspark.sql import functions as F

from fathom.llm import meetings, ngram_join

#: The groups of signatures 10 and 12 both hold B, which leads them, and C; A or D, twice, is in one of them alone.
B, C, A, D = 1, 2, 3, 4


SHAPE = "sig long, id long, n int, component long, bits array<long>, size int, main long, rest int"
ZERO = [0] * meetings.WORDS


@pytest.mark.parametrize("block, part", [(30, 8192), (2, 3)])
def test_every_pair_of_a_group_meets_once(spark, monkeypatch, block, part):
    """Rounds of 3, 12 and all other members; two texts an id; the grid of blocks and parts changes nothing."""
    monkeypatch.setattr(meetings, "BLOCK", block)
    monkeypatch.setattr(meetings, "PART", part)
    rows = [(7, i, 10, i, ZERO, 80, 0, 78) for i in range(40) for _ in (0, 0)]
    members, met = spark.createDataFrame(rows, SHAPE), []
    for skip, most in ((0, 3), (3, 12), (15, 192)):
        met += {(min(r), max(r)) for r in meetings.later_meetings(members, skip, most).collect()}
    assert sorted(met) == [(a, b) for a in range(40) for b in range(a + 1, 40)]


@pytest.mark.parametrize("part", [2048, 3])
def test_few_strangers_meet_the_largest_component_at_once(spark, monkeypatch, part):
    monkeypatch.setattr(meetings, "PART", part)
    rows = [(7, i, 10 if i < 8 else 100, 0 if i < 6 else i, ZERO, 10, 0, 4) for i in range(10)]
    met = [(min(r), max(r)) for r in meetings.later_meetings(spark.createDataFrame(rows, SHAPE), 0, 1).collect()]
    assert sorted(met) == sorted({(a, b) for a in range(8) for b in (6, 7) if a < b} | {(8, 9)})


@pytest.mark.parametrize("dropped", [10, 12])
def test_groups_that_differ_in_a_repeated_id_are_both_met(spark, monkeypatch, dropped):
    """Of the groups {b, c, a, a} and {b, c, d, d} only the first offers the link of c and a."""
    first = "p q r s t " + " ".join(f"w{i}" for i in range(40))
    docs = [(B, "b1 b2 b3 b4 b5 b6"), (C, first), (A, first + " z"), (A, "a1 a2 a3 a4 a5 a6"), (D, "d1 d2 d3 d4 d5 d6"), (D, "e1 e2 e3 e4 e5 e6")]
    sigs = {B: [10, 12], C: [10, 12], A: [dropped], D: [22 - dropped]}
    real = ngram_join.signed

    def planted(df, *args, **more):
        wanted = F.create_map(*[F.lit(x) for i, s in sigs.items() for x in (i, ",".join(map(str, s)))])
        return real(df, *args, **more).withColumn("sigs", F.split(F.element_at(wanted, F.col("id").cast("int")), ",").cast("array<long>"))

    monkeypatch.setattr(ngram_join, "signed", planted)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.join(df).collect()}
    assert got == {(B, B), (C, C), (A, C), (D, D)}
