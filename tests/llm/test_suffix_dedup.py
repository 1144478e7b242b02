"""Deep-shallow order equals plain sorting; removal equals brute force over all windows."""

import hashlib
import os
import random

import pytest

from fathom.llm import suffix_dedup
from fathom.llm.suffix_sort import deep_shallow


@pytest.mark.parametrize("seed", range(3))
def test_order_and_common_prefixes(seed):
    rng = random.Random(seed)
    base = [bytes(rng.choice(b"ab") for _ in range(200)) for _ in range(4)]
    strings = []
    for _ in range(300):
        s = bytearray(rng.choice(base)[: rng.randint(0, 200)])
        if s and rng.random() < 0.5:
            s[rng.randrange(len(s))] = rng.choice(b"abc")
        strings.append(bytes(s))
    order, shared = deep_shallow(strings)
    assert sorted(order) == list(range(300))
    assert [strings[i] for i in order] == sorted(strings)
    for a, b, n in zip(order, order[1:], shared[1:], strict=False):
        assert n == len(os.path.commonprefix([strings[a], strings[b]]))


def brute(texts):
    span, raw = suffix_dedup.SPAN, [(t or "").encode() for t in texts]
    seen = {}
    for r in raw:
        for i in range(len(r) - span + 1):
            seen[r[i : i + span]] = seen.get(r[i : i + span], 0) + 1
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - span + 1):
            if seen[r[i : i + span]] > 1:
                gone[i : i + span] = b"\x01" * span
        left = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        runs = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return out


def rows(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(80)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [prose(120) for _ in range(3)]
    texts = [None, "", "short", "For " * 40, "For " * 200, "For " * 101, "ab" * 205, "For " * 150 + prose(90)]
    for _ in range(40):
        kind = rng.randint(0, 4)
        if kind == 0:
            texts.append(prose(rng.randint(20, 200)))
        elif kind == 1:
            texts.append(prose(rng.randint(0, 60)) + rng.choice(shared)[rng.randint(0, 200) :] + prose(rng.randint(0, 60)))
        elif kind == 2:
            t = list(rng.choice(shared) + " " + rng.choice(shared))
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            texts.append("".join(t))
        elif kind == 3:
            texts.append(rng.choice(texts))
        else:
            texts.append(rng.choice(shared)[:399] + "#" + rng.choice(shared)[: rng.randint(398, 402)])
    return texts


@pytest.mark.parametrize(("seed", "hot"), [(1, 1000), (2, 3)])
def test_removal_equals_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = rows(seed)
    df = spark.createDataFrame([(i, t, b"k", 3) for i, t in enumerate(texts)], "doc_id long, text string, digest binary, copies int").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.dedup(df).collect()}
    for i, want in enumerate(brute(texts)):
        assert got[i][:4] == want, (i, texts[i])
        assert hashlib.sha256(got[i][4]).hexdigest() == want[3]


def test_odd_ids_and_empty(spark):
    assert suffix_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(None, "xy" * 300 + str(i)) for i in range(2)] + [(1, "q" * 500), (1, "q" * 500)], "doc_id long, text string")
    got = sorted((tuple(r)[:4] for r in suffix_dedup.dedup(df).collect()), key=repr)
    assert got == [(1, 500, 500, 1)] * 2 + [(None, 601, 600, 1)] * 2
