"""Signatures of linked sets meet; the join equals brute force with every class of shingle in play."""

import numpy as np
import pytest

from fathom.llm import meetings, ngram_join


def linked(x: set, y: set) -> bool:
    both = len(x & y)
    return both > 0 and 100 * both >= 80 * len(x | y)


@pytest.mark.parametrize("seed", range(4))
def test_linked_sets_share_a_signature(seed):
    rng = np.random.default_rng(seed)
    for _ in range(150):
        n = int(rng.integers(1, 260))
        pool = np.unique(rng.integers(0, 2**64, 2 * n + 20, dtype=np.uint64))
        rng.shuffle(pool)
        x = pool[:n]
        drop = int(rng.integers(0, n // 5 + 1))
        y = np.concatenate([x[drop:], pool[n : n + int(rng.integers(0, n // 6 + 1))]])
        kinds = dict(zip(pool.tolist(), rng.choice([1, 2, 3], len(pool), p=[[0.1, 0.5, 0.4], [0.8, 0.1, 0.1], [0, 0.5, 0.5], [0, 0, 1]][seed]), strict=True))
        x, y = np.unique(x), np.unique(y)
        if len(y) and linked(set(x.tolist()), set(y.tolist())):
            a, b = (ngram_join.signatures(t, np.array([kinds[v] for v in t.tolist()], np.int8)) for t in (x, y))
            assert len(np.intersect1d(a, b)), (len(x), len(y))


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(9)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: len(x) - int(rng.integers(0, n // 6 + 1))], rng.integers(0, 2**64, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64)]))
        ok = meetings.may_link(meetings.bitmap(x)[None, :], np.array([len(x)]), meetings.bitmap(y), len(y))[0]
        assert ok or not linked(set(x.tolist()), set(y.tolist()))


def brute(rows):
    sets = []
    for _, text in rows:
        words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for p in range(len(rows)):
        for q in range(p):
            if linked(sets[p], sets[q]):
                a, b = sorted((top(rows[p][0]), top(rows[q][0])))
                root[b] = a
    return sorted((i, len(s), top(i)) for (i, _), s in zip(rows, sets, strict=True))


@pytest.fixture
def made_frequent(monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    monkeypatch.setattr(ngram_join, "VERY", 8)
    monkeypatch.setattr(meetings, "HOT", 3)


def test_join_equals_brute_force(spark, made_frequent):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one  TWO"), (5, "one"), (6, "x " * 400)]
    at = 10
    for group in range(5):
        base = list(rng.choice(words, int(rng.integers(30, 120))))
        for _ in range(int(rng.integers(2, 14))):
            text = list(base)
            for _ in range(int(rng.integers(0, 6))):
                j = int(rng.integers(0, len(text)))
                text[j : j + 1] = list(rng.choice(words, int(rng.integers(0, 2))))
            rows.append((at, " ".join(text)))
            at += 1
        rows.append((at, " ".join(base)))
        rows.append((at + 1, " ".join(base).upper()))
        at += 2
    passage = list(rng.choice(words, 40))
    for _ in range(12):
        rows.append((at, " ".join([*passage, *rng.choice(words, int(rng.integers(4, 20)))])))
        at += 1
    df = spark.createDataFrame([(i, t, "x", 1.5) for i, t in rows], "doc_id long, text string, sig string, component double").repartition(3)
    got = sorted(map(tuple, ngram_join.join(df).collect()))
    assert got == brute(rows)


def test_empty_table_and_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.join(empty).collect() == []
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.join(df).collect()), key=repr) == [(7, 2, 7), (7, 2, 7), (9, 2, 7), (None, 2, None)]
