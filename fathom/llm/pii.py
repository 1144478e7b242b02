"""Personal data: fixed patterns, and a conditional random field that adds what these miss.

The patterns find e-mail addresses, IP addresses, card numbers (Luhn) and international phone
numbers; see ``base_spans``. The chain model labels the words that hold a digit or ``@`` as O or as
the begin or inside of a kind, by features of their shape and of the words around. All other words
are O by definition, so a text falls into independent runs of such words, and only these are
decoded, many runs side by side. It is fitted on ``labelled_table``, a small table of written-out
lines. Its spans pass their kinds' tests (``passes``): where one fails, its words are decoded again for the best labels
whose spans all pass (``passing``), so numbers side by side that it joins are found one by one. A span is added where it
overlaps no pattern's: national phone numbers, mostly. Runs of years and other plain numbers pass none.

Spans are (kind, start, end) in code points, end exclusive. Defined cases: null and empty texts have
none; repeated rows are treated alike and all kept; a text of any length is searched whole, in time
in proportion to it. Extra columns are kept by ``redact`` and dropped by ``find`` unless in ``keep``.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import batched, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import crf
from fathom.llm._text import column_bytes, pieces
from fathom.llm.quality import df_schema

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _local_start(text: str, at: int, least: int) -> int:
    """Where the run of local-part characters that ends at ``at`` begins, not before ``least``; looks back in growing steps."""
    step = 64
    while True:
        low = max(least, at - step)
        cut = [m.end() for m in _NOT_LOCAL.finditer(text, low, at)]
        if cut:
            return cut[-1]
        if low == least:
            return least
        step *= 8


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches of local part, @, domain, found from the @ on: the same matches in linear time."""
    end = 0
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            start = _local_start(text, at, end)
            if start < at:
                yield start, m.end()
                end = m.end()
        at = text.find("@", max(end, at + 1))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind's pattern that pass its test; failing ones are dropped, not retried."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


# --- the chain model -------------------------------------------------------------------------

_WORD = re.compile(r"[0-9@][^ \t\n\r\x0b\x0c]*")
_GAP = " \t\n\r\x0b\x0c"
_CUES = {"tel", "phone", "call", "fax", "mobile", "ip", "host", "server", "card", "visa", "mail", "email", "version", "token", "no", "id", "page", "cc", "isbn"}
_TRIM = re.compile(r"^[^0-9A-Za-z+(@]+|[^0-9A-Za-z]+$")


def shape(word: str) -> str:
    """Digits as 9 with their count, letters as a or A once, signs as they are."""
    s = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", word))
    s = re.sub(r"[^\x00-\x7f]+", "u", s)
    return re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 20)}", s)[:40]


def words_of(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring words that hold a digit or @, trimmed of outer signs; words of a run are one space apart."""
    runs: list[list[tuple[int, int]]] = []
    last = -2
    for m in _WORD.finditer(text):
        start = max(text.rfind(g, max(last, 0), m.start()) for g in _GAP) + 1 or max(last, 0)
        end = m.end()
        if start == last + 1 and runs and text[last] == " ":
            runs[-1].append((start, end))
        else:
            runs.append([(start, end)])
        last = end
    return runs


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    word = text[start:end]
    left = re.match(r"[^0-9A-Za-z+(@]*", word).end()
    right = len(re.sub(r"[^0-9A-Za-z]+$", "", word[left:])) + left
    return start + left, start + max(left, right)


def features(text: str, run: list[tuple[int, int]]) -> Iterator[list[str]]:
    """The features of each word of a run: its shape, its neighbours', the word before the run, and tests of digits and octets."""
    head = text[max(0, run[0][0] - 40) : run[0][0]].split()
    cue = re.sub(r"[^a-z]", "", head[-1].lower()) if head else ""
    cue = cue if cue in _CUES else ""
    inner = [text[slice(*trimmed(text, a, b))] for a, b in run]
    digits = ["".join(filter("0123456789".__contains__, w)) for w in inner]
    plain = [bool(w) and all(c in "0123456789-" for c in w) for w in inner]
    signs = ["" if text[b - 1].isalnum() else text[b - 1] for _, b in run]
    card, lo = [False] * len(inner), 0
    for same, group in groupby(plain):  # numbers side by side are joined once
        hi = lo + sum(1 for _ in group)
        if same and 13 <= len(joined := "".join(digits[lo:hi])) <= 19 and luhn(joined):
            card[lo:hi] = [True] * (hi - lo)
        lo = hi
    for i, w in enumerate(inner):
        parts = w.split(".")
        ip = len(parts) == 4 and all(p.isdigit() and p.isascii() and _small(p) for p in parts)
        yield [
            "bias", f"s:{shape(w)}", f"n:{min(len(digits[i]), 20)}", f"run:{min(len(run), 6)}", f"cue:{cue}", f"card:{card[i]}", f"own:{plain[i] and 13 <= len(digits[i]) <= 19 and luhn(digits[i])}", f"ip:{ip}",
            f"at:{'@' in w and '.' in w.partition('@')[2]}", f"plus:{w.startswith('+')}", f"par:{w.startswith('(')}",
            f"end:{signs[i]}", f"before:{signs[i - 1] if i else ''}", f"p:{shape(inner[i - 1])}" if i else "p:^", f"q:{shape(inner[i + 1])}" if i + 1 < len(inner) else "q:$",
        ]


def labelled_table(n: int = 30, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Lines with their spans: a small table, written out by rule, of personal data and of numbers that are none."""
    rng = random.Random(seed)
    d = lambda k, first="0123456789": rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(k - 1))
    filler = "the of to and with from line note entry und der les para".split()

    def card(spaced: bool) -> str:
        body = d(15, "3456")
        digits = next(body + c for c in "0123456789" if luhn(body + c))
        return " ".join(digits[i : i + 4] for i in range(0, 16, 4)) if spaced else digits

    def not_card() -> str:
        body = d(15)
        return next(body + c for c in "0123456789" if not luhn(body + c))

    makers = [
        ("phone", lambda: f"({d(3)}) {d(3)}-{d(4)}"), ("phone", lambda: f"({d(3)}) {d(3)}-{d(4)}"), ("phone", lambda: f"{d(3)}-{d(3)}-{d(4)}"), ("phone", lambda: f"+{d(1, '123456789')} ({d(3)}) {d(3)}-{d(4)}"),
        ("phone", lambda: f"+{d(2, '3456789')} {d(3)} {d(7)}"), ("email", lambda: f"ab.{d(2)}@mail{d(1)}.example.com"), ("email", lambda: f"x{d(3)}@example.org"),
        ("ip", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))), ("card", lambda: card(False)), ("card", lambda: card(True)),
        (None, not_card), (None, lambda: f"{rng.randint(1900, 2099)}"), (None, lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 9)}."), (None, lambda: f"{rng.randint(1900, 2099)}-{d(2)}-{d(2)}"),
        (None, lambda: f'"{rng.getrandbits(160):040x}"'), (None, lambda: f"${d(3)}.{d(2)}"), (None, lambda: f"{d(2)}:{d(2)}"), (None, lambda: d(rng.randint(1, 12))),
        (None, lambda: f"{rng.randint(256, 999)}.{d(3)}.{d(2)}.{d(2)}"), (None, lambda: f"{d(3)},{d(3)},{d(3)}"), (None, lambda: f"@{d(2)}"), (None, lambda: f"a{d(2)}b"), (None, lambda: f"{d(3)} {d(2)} {d(4)}"),
    ]
    cues = {"phone": ("tel", "call", "phone", ""), "email": ("mail", ""), "ip": ("ip", "host", ""), "card": ("card", "visa", ""), None: ("version", "token", "page", "no", "")}
    table = []
    for kind, make in makers:
        for _ in range(n):
            made = make()
            before = " ".join([rng.choice(filler), rng.choice(cues[kind])]).strip() + " "
            line = before + made + rng.choice(["", ".", ",", "!!", "***"]) + " " + rng.choice(filler)
            table.append((line, [(kind, len(before), len(before) + len(made))] if kind else []))
    for _ in range(n):  # numbers side by side, which the patterns take for one
        parts = [rng.choice([(card(False), True), (not_card(), False)]) for _ in range(rng.randint(2, 3))]
        line, spans = f"{rng.choice(filler)} ", []
        for made, real in parts:
            spans += [("card", len(line), len(line) + len(made))] * real
            line += f"{made} "
        table.append((line + rng.choice(filler), spans))
    plain = [lambda: f"{rng.randint(1900, 2099)}", lambda: d(rng.randint(1, 4)), lambda: f"{d(2)}:{d(2)}", lambda: f"{d(2)}.{d(1)}"]
    for i in range(2 * n):  # a phone among plain numbers, and plain numbers alone
        same = rng.choice(plain)()
        some = lambda: [same if i % 3 else rng.choice(plain)() for _ in range(rng.randint(0, 5))]  # noqa: B023, E731
        before, after = " ".join([rng.choice(filler), *some()]) + " ", " ".join(["", *some(), rng.choice(filler)])
        made = makers[rng.choice((0, 2, 3))][1]() if i % 2 else ""
        table.append((before + (made or same) + after, [("phone", len(before), len(before) + len(made))] if made else []))
    for i in range(2 * n):  # lists of phones, of one form or of several
        line, spans, one = f"{rng.choice(filler)} ", [], rng.choice((0, 2, 3))
        for _ in range(rng.randint(2, 6)):
            made = makers[one if i % 3 else rng.choice((0, 2, 3))][1]()
            spans.append(("phone", len(line), len(line) + len(made)))
            line += made + rng.choice((" ", ", ", "; "))
        table.append((line + rng.choice(filler), spans))
    return table


@lru_cache(maxsize=1)
def model() -> tuple[crf.Chain, dict[str, int]]:
    """The chain fitted on the labelled table, and the numbers of its features."""
    chains, labels = [], []
    for text, spans in labelled_table():
        for run in words_of(text):
            tags, open_ = [], None
            for a, b in run:
                hit = next((s for s in spans if s[1] < b and a < s[2]), None)
                tags.append(0 if hit is None else LABELS.index(f"{'I' if hit == open_ else 'B'}-{hit[0]}"))
                open_ = hit
            chains.append(list(features(text, run)))
            labels.append(tags)
    number = {f: i for i, f in enumerate(sorted({f for c in chains for fs in c for f in fs}))}
    inside = np.array([x[0] == "I" for x in LABELS])
    allowed = np.array([[not inside[j] or LABELS[i][2:] == LABELS[j][2:] != "" for j in range(len(LABELS))] for i in range(len(LABELS))])
    x = [[[number[f] for f in fs] for fs in c] for c in chains]
    return crf.fit(x, labels, len(number), len(LABELS), allowed, ~inside), number


#: Words of a span at most: as many as a card has digits.
WORDS = 19


def passing(text: str, words: list[tuple[int, int]], e: np.ndarray, chain: crf.Chain) -> list[Span]:
    """The spans of the words' best labels among those whose spans all pass their kinds' tests. e: (words, labels), their scores."""
    ends = [trimmed(text, a, b) for a, b in words]
    digits = np.r_[0, np.cumsum([sum(c in "0123456789" for c in text[a:b]) for a, b in words])]
    # After i words, by the last one's label: the score, and whence: (words before, their last label, span or null).
    best: list[dict[int, tuple[float, tuple | None]]] = [{-1: (0.0, None)}] + [{} for _ in words]
    move = lambda p, q: chain.first[q] if p < 0 else chain.move[p, q]
    for i in range(len(words)):
        for p, (score, _) in best[i].items():
            steps = [(i + 1, 0, score + move(p, 0) + e[i, 0], None)]
            for kind in KINDS:
                b, inner = LABELS.index(f"B-{kind}"), LABELS.index(f"I-{kind}")
                total = score + move(p, b) + e[i, b]
                for j in range(i + 1, min(len(words), i + WORDS) + 1):
                    if j > i + 1:
                        total += chain.move[b if j == i + 2 else inner, inner] + e[j - 1, inner]
                    if digits[j] - digits[i] > 19:
                        break
                    if ends[i][0] < ends[j - 1][1] and passes(kind, text[ends[i][0] : ends[j - 1][1]]):
                        steps.append((j, b if j == i + 1 else inner, total, (kind, ends[i][0], ends[j - 1][1])))
            for j, q, total, span in steps:
                if q not in best[j] or total > best[j][q][0]:
                    best[j][q] = (total, (i, p, span))
    at, label, out = len(words), max(best[-1], key=lambda q: best[-1][q][0]), []
    while at:
        at, label, span = best[at][label][1]
        out += [span] if span else []
    return out[::-1]


#: Runs of up to LONGEST words are decoded side by side, so many at once; a longer run is decoded whole, by itself, its scores taken for SCORED words at a time.
TOGETHER, LONGEST, SCORED = 2048, 64, 4096


def chain_spans(texts: list[str], fitted: tuple[crf.Chain, dict[str, int]]) -> list[list[Span]]:
    chain, number = fitted
    out: list[list[Span]] = [[] for _ in texts]
    held: list[tuple[int, list[tuple[int, int]]]] = []

    def numbers(i: int, run: list[tuple[int, int]]) -> Iterator[list[int]]:
        return ([number[f] for f in fs if f in number] for fs in features(texts[i], run))

    def add(i: int, run: list[tuple[int, int]], tags: list[int]) -> None:
        t = 0
        while t < len(run):
            if tags[t] == 0:
                t += 1
                continue
            kind, u = LABELS[tags[t]][2:], t + 1
            while u < len(run) and LABELS[tags[u]] == f"I-{kind}":
                u += 1
            start, end = trimmed(texts[i], *run[t])[0], trimmed(texts[i], *run[u - 1])[1]
            if start < end and passes(kind, texts[i][start:end]):
                out[i].append((kind, start, end))
            else:  # what looks like one may be several, or none
                out[i] += passing(texts[i], run[t:u], chain.scores(crf.padded([list(numbers(i, run[t:u]))], len(chain.emit) - 1)[0])[0], chain)
            t = u

    def decode() -> None:
        held.sort(key=lambda r: len(r[1]))
        for low in range(0, len(held), TOGETHER):
            part = held[low : low + TOGETHER]
            for (i, run), tags in zip(part, chain.viterbi([list(numbers(i, run)) for i, run in part]), strict=True):
                add(i, run, tags)
        held.clear()

    def decode_long(i: int, run: list[tuple[int, int]]) -> None:
        scores = [chain.scores(crf.padded([list(some)], len(chain.emit) - 1)[0])[0] for some in batched(numbers(i, run), SCORED)]
        add(i, run, chain.paths(np.concatenate(scores)[None], np.array([len(run)]))[0])

    for i, text in enumerate(texts):
        for run in words_of(text):
            if len(run) > LONGEST:
                decode_long(i, run)
            else:
                held.append((i, run))
        if len(held) >= 4 * TOGETHER:
            decode()
    decode()
    return out


_PHONE_LIKE = re.compile(r"\+?[0-9(][ ().0-9-]*[0-9]")


def passes(kind: str, text: str) -> bool:
    """The test of each kind that a span of the chain must pass: what the kind's numbers look like, and for card and phone
    the patterns' counts of digits. A phone shows a sign that plain numbers side by side lack."""
    digits = sum(c in "0123456789" for c in text)
    if kind == "email":
        name, at, domain = text.partition("@")
        return bool(name and at) and "." in domain.strip(".")
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and _small(p) for p in parts)
    if kind == "card":
        return _CARD.fullmatch(text) is not None and 13 <= digits <= 19 and luhn(re.sub("[ -]", "", text))
    return _PHONE_LIKE.fullmatch(text) is not None and 9 <= digits <= 15 and any(c in text for c in "+(-")


def all_spans(texts: list[str], fitted: tuple[crf.Chain, dict[str, int]]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, by kind as listed, then start."""
    out = []
    for text, more in zip(texts, chain_spans(texts, fitted), strict=True):
        base = base_spans(text)
        free = [s for s in more if not any(s[1] < b and a < s[2] for _, a, b in base)]
        order = lambda s: (KINDS.index(s[0]), s[1], s[2])
        out.append((base, sorted([*base, *free], key=order)))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


#: Bytes of text that are searched at once.
TEXT = 1 << 20
FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, spans_list array<struct<kind:string,start:int,end:int>>"
_LIST = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``; how many spans of each kind the patterns find, and their digest; all spans as text and as a list."""
    fitted = model()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in pieces(column_bytes(batch.column(0))[1], TEXT):
                part = batch.slice(low, high - low)
                found = all_spans([t or "" for t in part.column(0).to_pylist()], fitted)
                counts = [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS]
                made = [
                    *counts, pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([written(a) for _, a in found], pa.string()),
                    pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in a] for _, a in found], _LIST),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], [*keep, *(c.split()[0] for c in FOUND.split(", "))])

    return df.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(work, f"{df_schema(df, keep)}, {FOUND}")


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with each span as its kind in angle brackets; overlapping spans become one, named for the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the spans in ``text`` masked; all other columns and the order of columns stay. A null text stays null."""
    fitted, place = model(), df.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in pieces(column_bytes(batch.column(place))[1], TEXT):
                part = batch.slice(low, high - low)
                texts = part.column(place).to_pylist()
                found = all_spans([t or "" for t in texts], fitted)
                made = pa.array([t if t is None else masked(t, a) for t, (_, a) in zip(texts, found, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([made if i == place else c for i, c in enumerate(part.columns)], part.schema.names)

    return df.mapInArrow(work, df.schema)
