"""Long runs of number-bearing words are decoded whole; numbers side by side are found one by one."""

import numpy as np
import pytest

from fathom.llm import pii


def some_phones(n, form, seed=1):
    rng = np.random.default_rng(seed)
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    forms = [lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}"]
    return [forms[form if form < 2 else int(rng.integers(0, 2))]() for _ in range(n)]


@pytest.mark.parametrize("form", [0, 1, 2])
@pytest.mark.parametrize("between", [" ", ", ", "; ", "  "])
@pytest.mark.parametrize("n", [2, 3, 7, 20, 80, 300])
def test_neighbouring_phones_are_all_found(n, between, form):
    phones = some_phones(n, form, n)
    text = f"call {between.join(phones)} now"
    spans, at = [], 0
    for p in phones:
        at = text.index(p, at)
        spans.append(("phone", at, at + len(p)))
        at += len(p)
    base, found = pii.all_spans([text], pii.model())[0]  # plain forms side by side may make a card by chance: the patterns' spans stay
    free = [s for s in spans if not any(s[1] < b and a < s[2] for _, a, b in base)]
    assert [s for s in found if s not in base] == free and len(free) >= 0.8 * n
    if not base:
        assert pii.masked(text, found) == f"call {between.join(['<PHONE>'] * n)} now"


def test_best_labels_whose_spans_pass():
    """Scores that favour one phone over all words still give the two that pass, and nothing where none does."""
    chain, _ = pii.model()
    text = "(212) 555-1234 (213) 555-9876"
    words = [m for run in pii.words_of(text) for m in run]
    e = np.zeros((len(words), len(pii.LABELS)))
    e[:, pii.LABELS.index("I-phone")] = 9
    e[:, pii.LABELS.index("B-phone")] = 5
    assert [text[a:b] for _, a, b in pii.passing(text, words, e, chain)] == ["(212) 555-1234", "(213) 555-9876"]
    years = "2024 2025 2026"
    assert pii.passing(years, pii.words_of(years)[0], e[:3], chain) == []


def test_an_entity_across_any_word_of_a_long_run():
    entity = "(212) 555-1234"
    for filler in ("17 ", "12 ", "2024 "):
        for lead in (0, 1, 10, 61, 62, 63, 64, 65, 127, 10_000):
            before = filler * lead
            found = pii.all_spans([f"{before}{entity} " + filler * 70], pii.model())[0][1]
            assert ("phone", len(before), len(before) + len(entity)) in found, (filler, lead, found[:5])


def test_numbers_that_are_no_personal_data():
    years = [" ".join(f"{y}" for y in range(1990, 1990 + n)) for n in (1, 3, 4, 10, 62, 65)]
    texts = [*years, "2024 " * 62, "2024 " * 10_000, "12 " * 65, "rows 4711 4712 4713 4714", "3.5 4.5 5.5 6.5", "10:30 11:30 12:30 13:30"]
    for text in texts:
        base, found = pii.all_spans([text], pii.model())[0]
        assert found == base, (text[:40], found[:5])
        assert [s for s in found if s[0] != "card"] == []


def test_every_span_passes_its_kind():
    rows = pii.labelled_table(20, seed=5)
    for (text, _), (base, found) in zip(rows, pii.all_spans([t for t, _ in rows], pii.model()), strict=True):
        assert all(pii.passes(k, text[a:b]) for k, a, b in found if (k, a, b) not in base)
    bad = {"email": ("a@", "@b.c", "a@b"), "ip": ("1.2.3", "1.2.3.256", "1.2.3.x"), "card": ("1234567812345678", "4111 1111 1111"), "phone": ("2024 2024 2024", "(212) 5", "1" * 16 + "-1")}
    assert not any(pii.passes(k, x) for k, xs in bad.items() for x in xs)
    assert pii.passes("phone", "(212) 555-1234") and pii.passes("card", "4111 1111 1111 1111") and pii.passes("ip", "1.2.3.255") and pii.passes("email", "a@b.c")


def test_long_runs_take_time_in_proportion():
    text = "123456789 " * 40_000
    fs = sum(1 for _ in pii.features(text, pii.words_of(text)[0]))
    assert fs == 40_000 and pii.all_spans([text], pii.model())[0][0] == []


def test_a_long_run_equals_short_ones_decoded_alike(monkeypatch):
    text = " ".join(["12:30", "(212) 555-1234", "2024-01-05", "a7b", "10.0.0.1"] * 12)
    short = pii.chain_spans([text], pii.model())
    monkeypatch.setattr(pii, "LONGEST", 8)
    monkeypatch.setattr(pii, "SCORED", 7)
    assert len(pii.words_of(text)[0]) > 8 and pii.chain_spans([text], pii.model()) == short != [[]]
