"""The two fitted models beside plain restatements of their formulas."""

import itertools
import math
import random

import numpy as np
import pytest

from fathom.llm import quality, toxicity


def logistic(x):
    return 1 / (1 + math.exp(-x))


def test_machine_equals_a_double_loop_over_pairs():
    rng = np.random.default_rng(4)
    weights, vectors, bias = rng.normal(size=9), rng.normal(size=(9, 3)), 0.3
    docs = [sorted(rng.choice(9, rng.integers(0, 7), replace=False).tolist()) for _ in range(40)]
    row, term = np.repeat(np.arange(40), [len(d) for d in docs]), np.array([t for d in docs for t in d])
    got = toxicity.predict(row, term, 40, bias, weights, vectors)
    for d, x in zip(docs, got, strict=True):
        want = bias + sum(weights[t] for t in d) + sum(sum(vectors[a] * vectors[b]) for a, b in itertools.combinations(d, 2))
        assert x == pytest.approx(want)


def test_evidence_equals_the_statistic_by_hand(monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST", 0)
    rng = random.Random(6)
    y = np.array([float(rng.random() < 0.3) for _ in range(400)])
    docs = [sorted({t for t in range(12) if rng.random() < (0.1 + 0.06 * t if label else 0.3)}) for label in y]
    row, code = np.repeat(np.arange(400), [len(d) for d in docs]), np.array([t for d in docs for t in d])
    want = []
    for t in range(12):
        cells = [sum(1 for d, label in zip(docs, y, strict=True) if (t in d) == has and label == one) for has in (True, False) for one in (1, 0)]
        rows, columns = (cells[0] + cells[1], cells[2] + cells[3]), (cells[0] + cells[2], cells[1] + cells[3])
        g = 2 * sum(c * math.log(c * 400 / (rows[i // 2] * columns[i % 2])) for i, c in enumerate(cells) if c)
        want += [t] * (g >= toxicity.EVIDENCE)
    assert want and len(want) < 12 and toxicity.informative(row, code, y).tolist() == want


def graded(seed, grades):
    """Rows of (buckets, values, grade), the grade told by one bucket and noise."""
    rng = random.Random(seed)
    rows = []
    for _ in range(300):
        x = [rng.random() for _ in range(4)]
        rows.append(([1, 5, 7, 9], x, min(grades - 1, max(0, int(grades * (0.2 + 0.6 * x[1]) + rng.gauss(0, 0.4))))))
    return rows


@pytest.mark.parametrize("grades", [2, 3, 4])
def test_ordinal_probabilities_and_the_optimum(grades):
    rows = graded(grades, grades)
    model = quality.fit(rows, rounds=1500)
    x = np.array([sum(model.weights[b] * v for b, v in zip(bs, vs, strict=True)) for bs, vs, _ in rows])
    assert (np.diff(model.thresholds) > 0).all()

    def chances(score, cuts):
        below = [0.0, *[logistic(c - score) for c in cuts], 1.0]
        return [b - a for a, b in zip(below[:-1], below[1:], strict=True)]

    for s, e, p in zip(x, model.expected(x), model.at_least(x, model.grades[-1]), strict=True):
        own = chances(s, model.thresholds)
        assert e == pytest.approx(sum(g * q for g, q in zip(model.grades, own, strict=True))) and p == pytest.approx(own[-1])

    def loss(weights, cuts):
        return -sum(math.log(chances(sum(weights[b] * v for b, v in zip(bs, vs, strict=True)), cuts)[g]) for bs, vs, g in rows) / len(rows)

    at = {b: model.weights[b] for b in (1, 5, 7, 9)}
    best = loss(at, list(model.thresholds))
    for step in (3e-2, -3e-2):  # the fit's gradient led to where no coordinate improves
        for b in at:
            assert loss(at | {b: at[b] + step}, list(model.thresholds)) >= best - 1e-4
        for i in range(grades - 1):
            assert loss(at, [c + step * (i == j) for j, c in enumerate(model.thresholds)]) >= best - 1e-4
