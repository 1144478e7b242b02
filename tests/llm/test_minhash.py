"""MinHash: agreement of bins, no link lost against brute force, defined cases."""

import re

import numpy as np
import pytest

from fathom.llm import meetings, minhash


def sets_of(rows, k=2):
    out = []
    for _, text in rows:
        words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]
        out.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set())
    return out


def brute(rows):
    sets, root = sets_of(rows), {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for p in range(len(rows)):
        for q in range(p):
            both = len(sets[p] & sets[q])
            if both and 100 * both >= 80 * len(sets[p] | sets[q]):
                a, b = sorted((top(rows[p][0]), top(rows[q][0])))
                root[b] = a
    return sorted((i, len(s), top(i), top(i) == i) for (i, _), s in zip(rows, sets, strict=True))


@pytest.mark.parametrize("n, drop", [(5, 1), (10, 2), (40, 8), (600, 120)])
def test_bins_agree_as_sets_do(n, drop):
    """Also in sets far smaller than the number of bins, which densification fills."""
    rng = np.random.default_rng(n)
    bins, agree = minhash.BANDS * minhash.ROWS, []
    for _ in range(60):
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        y = x[drop:]
        both, own = np.concatenate([x, y]), np.r_[np.zeros(len(x), int), np.ones(len(y), int)]
        values = minhash.densified(minhash.bins_of(both, own, 2, bins))
        assert (values != minhash.EMPTY).all()
        agree.append((values[0] == values[1]).mean())
        bands = minhash.band_signatures(values)
        assert (bands[0] == bands[1]).any()
    assert abs(np.mean(agree) - (n - drop) / n) < 0.05


def test_one_value_fills_all_bins_and_none_fills_none():
    values = minhash.densified(minhash.bins_of(np.array([77], np.uint64), np.array([0]), 2, 192))
    assert len(np.unique(values[0])) == 1 and values[0][0] != minhash.EMPTY and (values[1] == minhash.EMPTY).all()


def corpus(rng, passage_words=30):
    words = [f"w{i}" for i in range(300)]
    rows, at = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one  TWO"), (5, "one"), (6, "ONE"), (7, "x " * 400)], 10
    for _ in range(6):
        base = list(rng.choice(words, int(rng.integers(12, 120))))
        for _ in range(int(rng.integers(2, 14))):
            text = list(base)
            for _ in range(int(rng.integers(0, 7))):
                j = int(rng.integers(0, len(text)))
                text[j : j + 1] = list(rng.choice(words, int(rng.integers(0, 2))))
            rows.append((at, " ".join(text)))
            at += 1
        rows += [(at, " ".join(base)), (at + 1, " ".join(base).upper())]
        at += 2
    passage = list(rng.choice(words, passage_words))
    for _ in range(25):
        rows.append((at, " ".join([*passage, *rng.choice(words, int(rng.integers(2, 16)))])))
        at += 1
    return rows


@pytest.mark.parametrize("seed, hot", [(5, 1000), (6, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(meetings, "HOT", hot)
    rows = corpus(np.random.default_rng(seed))
    df = spark.createDataFrame([(i, t, "x", 1.5, True) for i, t in rows], "doc_id long, text string, sig string, component double, kept boolean").repartition(3)
    out = minhash.dedup(df)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, out.collect())) == brute(rows)


def test_a_chain_that_the_centre_is_not_part_of(spark):
    """All share a passage, so they meet in buckets; the least document links with none of the others, which link in a chain."""
    rng = np.random.default_rng(8)
    word = lambda n: [f"v{i}" for i in rng.integers(0, 10**9, n)]
    passage = word(30)
    tails = word(200)
    rows = [(1, " ".join([*passage, *word(20)]))]
    rows += [(2 + i, " ".join([*passage, *tails[3 * i : 3 * i + 20]])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, minhash.dedup(df).collect())) == brute(rows)


def test_ids_and_empty_tables(spark):
    assert minhash.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "p q r s t"), (9, "P Q R S T"), (8, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, minhash.dedup(df).collect()), key=repr) == [(7, 4, 7, True), (7, 5, 7, True), (8, 5, 7, False), (9, 4, 7, False), (None, 5, None, None)]
