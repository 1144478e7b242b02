"""Near copies whose group's leader links with none of them."""

from pyspark.sql import functions as F

from fathom.llm import meetings, ngram_join

BASE = " ".join(f"w{i}" for i in range(60))


def test_texts_that_are_compared_grow_with_the_group_not_with_its_pairs(spark, monkeypatch):
    """60 near copies are 1770 pairs, all linked; the leader, of the least id, is of other words."""
    real, seen = ngram_join.signed, []
    monkeypatch.setattr(ngram_join, "signed", lambda df, *a, **more: real(df, *a, **more).withColumn("sigs", F.array(F.lit(10).cast("long"))))
    checked = meetings.verified
    monkeypatch.setattr(meetings, "verified", lambda pairs, *a, **more: seen.append(pairs.count()) or checked(pairs, *a, **more))
    docs = [(0, " ".join(f"v{i}" for i in range(64))), *((i, f"{BASE} z{i}") for i in range(1, 61))]
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(0, 0), *((i, 1) for i in range(1, 61))}
    assert sum(seen) <= 2 * len(docs)


def test_pairs_kept_back_are_named_once_others_did_not_link(spark, monkeypatch):
    """Bitmaps that rule nothing out: whichever pairs are named first, the links are those of brute force."""
    shape = "sig long, id long, n int, component long, bits array<long>, size int, main long, rest int"
    rows = [(7, i, 10, i, [0] * meetings.WORDS, 9, 0, 8) for i in range(9)]
    got = [tuple(r) for r in meetings.later_meetings(spark.createDataFrame(rows, shape), 0, 64, True).collect()]
    assert (7, None) in got and len([b for _, b in got if b is not None]) == 8
    two = meetings.later_meetings(spark.createDataFrame([(*r[:5], 2, 0, 1) for r in rows[:2]], shape), 0, 64, True)
    assert [tuple(sorted(r)) for r in two.collect()] == [(0, 1)]
    monkeypatch.setattr(meetings, "may_link", lambda bits, n, other, m, percent=80: n > 0)
    mark = lambda *at: " ".join(f"x{i}" if i in at else f"w{i}" for i in range(60))
    real = ngram_join.signed
    monkeypatch.setattr(ngram_join, "signed", lambda df, *a, **more: real(df, *a, **more).withColumn("sigs", F.array(F.lit(10).cast("long"))))
    docs = [(0, "p q r s t u"), (1, mark(0)), (2, mark(20, 40)), (3, mark(0, 59)), (4, mark(20, 40, 59)), (5, mark(10, 30, 50)), (6, mark(10, 30, 50, 59))]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}

    def shingles(text):
        words = text.split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    sets = {i: shingles(t) for i, t in docs}
    want = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            want[i] = min(want[j] for j in sets if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    assert got == want and len(set(want.values())) > 2


def test_few_pairs_that_join_nothing_are_named_at_once(spark):
    """Ten strangers and a group of forty: of the pairs of three that resemble each other the third joins nothing, and no group is gone through again for it."""
    shape = "sig long, id long, n int, component long, bits array<long>, size int, main long, rest int"
    bits = lambda i: [-1 if i > 10 or i > 3 and j // 3 == i else 0 for j in range(meetings.WORDS)]
    rows = [(7, i, 10, min(i, 11), bits(i), 50, 11, 10) for i in range(1, 51)]
    got = [tuple(r) for r in meetings.later_meetings(spark.createDataFrame(rows, shape), 0, 64, True).collect()]
    assert sorted(tuple(sorted(r)) for r in got) == [(1, 2), (1, 3), (2, 3)]


def test_signatures_are_read_from_one_table_and_gone_once_documents_have_met(spark, monkeypatch):
    """The tables that hold signatures while texts are compared; the postings' semi-join has none of its own."""
    real, alive, seen = meetings.kept, {}, []
    monkeypatch.setattr(ngram_join, "kept", lambda df, name, *a: alive.setdefault(name, real(df, name, *a)))
    monkeypatch.setattr(meetings, "kept", lambda df, name, *a: alive.setdefault(name, real(df, name, *a)))
    checked = meetings.verified
    left = lambda: [k for k, df in alive.items() if "sigs" in df.columns and df.kept_at]
    monkeypatch.setattr(meetings, "verified", lambda *a, **more: seen.append(left()) or checked(*a, **more))
    docs = [(i, f"{BASE} z{i // 2}") for i in range(12)] + [(99, "")]
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {*((i, 0) for i in range(12)), (99, 99)}
    assert "signed" in alive and seen and not any(seen)
