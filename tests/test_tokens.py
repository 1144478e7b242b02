"""Tokens of texts in any script beside a plain Python form; no text is moved for its normal form."""

import random
import re
import unicodedata

from fathom.functions import tokens as T

CHARS = "aé’“—…ﬁＡПривет漢字がが́e각한ো² .,5"


def plain(text):
    found = [m[0].lower() for m in re.finditer(T.PATTERN, text or "")]
    prose = unicodedata.normalize("NFKC", re.sub(T.PATTERN, " ", text or ""))
    words = re.split(r"[^\w]+", prose)
    return sorted(found + [w.lower() for w in words if 2 <= len(w) <= T.LONGEST])


def test_steady_texts_are_their_own_normal_form():
    ranges, rng = T._steady_ranges(), random.Random(4)
    inside = lambda c: any(a <= ord(c) <= b for a, b in ranges)
    assert all(map(inside, "aé’“—Привет漢字한か")) and not any(map(inside, "…ﬁＡ²゙́ᅡᆨা"))
    for _ in range(3000):
        a, b = rng.choice(ranges)
        text = "".join(chr(rng.randint(*rng.choice([(a, b), (97, 122), rng.choice(ranges)]))) for _ in range(6))
        assert unicodedata.normalize("NFKC", text) == text, [hex(ord(c)) for c in text]


def test_tokens_in_any_script(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(CHARS) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    texts += ["“Привет” — мир’s CVE-2024-1234 on 10.0.0.1", "ﬁle.example.com ﬁle", "naïve naïve", None, "", "漢字 " * 50]
    df = T.tokenized(spark.createDataFrame(enumerate(texts), "i int, text string").repartition(2), "text", "t")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the test's own
    letters = re.compile(r"[^\W]+")
    got = {r["i"]: sorted(r["t"]) for r in df.collect()}
    for i, text in enumerate(texts):
        if text is None or not re.search(r"ে|া", unicodedata.normalize("NFKC", text)):  # marks that Python's \w and the engine's letters tell apart
            assert [w for w in got[i] if letters.fullmatch(w)] == [w for w in plain(text) if letters.fullmatch(w)], text
