"""The other corpus operators beside brute force, exact round trips and held-out accuracy, on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fathom.llm import bpe, crf, decontaminate, media, pii, quality, toxicity, url_filters, warc

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# --- URL filters -----------------------------------------------------------------------------


def _urls(spark):
    rows = ["https://a.example.com/en/7?x", "HTTP://A.EXAMPLE.COM/en/8", "ftp://x.net/de/1", "http://b.example.net/de/81", "http://example.net/de/9", "http://free-bets.example.org/es/1", "http://q.casino-win.com/a", "odd", "", None, "http://org/es", "http://xexample.com/fr/", "http://u@example.com:80/en/7", "http://example.org/help/casino-win.", "//free-bets.com/", "http://x.org/adserver/", "http://x.org/adserver", "http://com/en/\n"]
    return spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate(rows * 2)], "page_id long, url string, host int, rule string")


def test_url_rules_by_literal_and_by_join(spark, monkeypatch):
    from fathom.llm.q01_urls import SITES

    sites, patterns = [url_filters.site_rule(a, t) for a, t in SITES], [url_filters.pattern_rule(p) for p in (*url_filters.PATTERNS, "*n*w*/zz|")]
    by_literal = url_filters.judge(_urls(spark), sites, patterns)
    got = {tuple(r) for r in by_literal.select("page_id", "host", "path", "rule", "verdict").collect()}
    monkeypatch.setattr(url_filters, "LITERAL_RULES", 0)
    assert got == {tuple(r) for r in url_filters.judge(_urls(spark), sites, patterns).select("page_id", "host", "path", "rule", "verdict").collect()}

    def brute(url):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
        fits = [(len(t), t, a) for a, t in SITES for h, p in [(t.partition("/")[0], "/" + t.partition("/")[2])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, None)))

    for page, host, path, rule, verdict in got:
        want = brute(_urls(spark).where(f"page_id = {page}").first()["url"])
        assert (host, path, rule) == want[:3] and (want[3] is None or verdict == want[3])
    by = {r[0]: r[4] for r in got}
    assert by[6] == "block" and by[13] == "allow" and by[15] == "block" and by[16] == "allow" and by[7] == by[9] == "allow"
    assert url_filters.judge(_urls(spark).limit(0), sites, patterns).collect() == []


def test_rules_are_filed_under_the_rarest_token():
    rule = url_filters.site_rule("block", "example.com/en/7")
    assert set(rule.tokens) == {"example", "com", "en"}  # 7 may go on in a URL
    assert url_filters.filed([rule], {"example": 9, "com": 9, "en": 2})[0][0] == "en"
    assert url_filters.pattern_rule("*ads*").tokens == ()


# --- BPE ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference_encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("ab 'st\n\t\x1c\x85\xa0 　éß日٣²'ll", max_size=60)), max_size=4))
def test_encoding_equals_the_library_and_decodes(texts):
    vocab = bpe.vocabulary(RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    for text, ids in zip(texts, bpe.encode_batch(texts, bpe.Words(vocab), public_tokenizers.PATTERN), strict=True):
        assert ids.tolist() == own.encode_ordinary(text)
        assert bpe.decode_ids(ids.tolist(), vocab) == text.encode()


def test_long_words_and_table(spark, reference_encoding):
    rng = random.Random(4)
    texts = [None, "", "word " * 3, "".join(rng.choice("thersingotiona") for _ in range(5000)), "ab" * 4000, "word " * 3]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r for r in bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        want = reference_encoding.encode_ordinary(t or "")
        assert list(got[i]["ids"]) == want and got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS)
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_higher_order_fold_equals_the_batch_form(spark):
    ranks = {bytes([b]): i for i, b in enumerate(b"abcdehnt ")}
    for token in (b"th", b"he", b"the", b" th", b" the", b"an", b"and", b"bb", b"abb"):
        ranks[token] = len(ranks)
    vocab, rng = bpe.Vocabulary(ranks), random.Random(2)
    words = [b"", *{bytes(rng.choice(b"abdehnt ") for _ in range(rng.randint(1, 12))) for _ in range(60)}]
    df = spark.createDataFrame([(bytearray(w),) for w in words], "word binary")
    ids, offsets = bpe.fold(words, vocab)
    got = {bytes(r["word"]): list(r["ids"]) for r in bpe.fold_words(df, ranks, buckets=8).collect()}
    for i, w in enumerate(words):
        assert got[w] == ids[offsets[i] : offsets[i + 1]].tolist() == bpe.fold_long(w, vocab)


# --- quality and toxicity -------------------------------------------------------------------------


def _graded(spark, n=400):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        grade = i % 3
        text = " ".join(rng.choice(words) + ["$$$", "#", ""][grade] * (rng.random() < 0.6) for _ in range(rng.randint(8, 120)))
        toxic = int(rng.random() < 0.3)
        if toxic:
            at = text.split()
            at.insert(rng.randrange(len(at)), rng.choice(["Badword!", "worse"]))
            text = " ".join(at)
        docs.append((i, text, 0.5, "q"))
        labels.append((i, grade, toxic))
    docs += [(n, None, None, None), (n + 1, "", None, None), (None, "x", None, None), (0, docs[0][1], None, None)]
    labels += [(n, None, None), (10**9, 1, 1), (None, 1, 1), (0, 2, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score double, b string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_ordinal_grades(spark):
    docs, labels = _graded(spark)
    model = quality.train(docs, labels.where("doc_id % 4 <> 0"))
    assert model.grades == [0, 1, 2] and (np.diff(model.thresholds) > 0).all()
    rows = quality.score(docs, model).collect()
    assert len(rows) == 404
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] % 4 == 0 and r["doc_id"] < 400]
    assert sum(round(r["expected_grade"]) == r["doc_id"] % 3 for r in held) / len(held) > 0.9
    assert all(0 <= r["p_keep"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in rows)
    none = quality.train(docs, labels.limit(0))
    assert {r["expected_grade"] for r in quality.score(docs, none).collect()} == {0.0}


def test_toxicity_learns_without_held_out_labels(spark):
    docs, labels = _graded(spark)
    model = toxicity.train(docs, labels)
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    again = toxicity.train(docs, flipped)
    assert np.array_equal(model.weights, again.weights) and model.bias == again.bias
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = [r for r in toxicity.score(docs, model).collect() if r["doc_id"] is not None]
    held = [r for r in rows if r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["doc_id"]]
    assert sum((r["score"] >= 0.5) == (truth[r["doc_id"]] == 1) for r in held) / len(held) > 0.9
    none = toxicity.train(docs, labels.limit(0))
    assert all(abs(r["score"] - 0.5) < 1e-9 for r in toxicity.score(docs, none).collect())


def test_machine_learns_pairs():
    """Neither term alone tells; both together do."""
    rng = random.Random(1)
    docs, y = [], []
    for _ in range(600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        docs.append([10] * a + [20] * b + [30 + rng.randrange(5)])
        y.append(int(a and b or not (a or b)))
    model = toxicity.fit(docs, y, rounds=800)
    row = np.repeat(np.arange(4), [1, 2, 2, 3])
    term = np.searchsorted(model.known, [30, 10, 30, 20, 30, 10, 20, 30])
    p = toxicity.sigmoid(toxicity.predict(row, term, 4, model.bias, model.weights, model.vectors))
    assert p[3] > 0.5 > max(p[1], p[2])


# --- decontamination -----------------------------------------------------------------------------


def _distance(item, text):
    before = list(range(len(item) + 1))
    best = before[-1]
    for c in text:
        now = [0]
        for i, x in enumerate(item):
            now.append(min(before[i] + (x != c), before[i + 1] + 1, now[i] + 1))
        before, best = now, min(best, now[-1])
    return best


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_edit_matches_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    rng = random.Random(6)
    items = [(i, "".join(rng.choice("abc DEé") for _ in range(n))) for i, n in enumerate([3, 9, 20, 33, 50, 70, 130])] + [(90, None), (91, ""), (92, "abc")]
    items.append((93, items[4][1]))
    docs = [(0, None), (1, "")]
    for i in range(40):
        text = list(rng.choice(items[:7])[1])
        for _ in range(rng.randint(0, 8)):
            j = rng.randrange(len(text) + 1)
            text[j : j + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        docs.append((i + 2, "".join(rng.choice("abc de") for _ in range(rng.randint(0, 30))) + "".join(text) + "z" * rng.randint(0, 20)))
    df = spark.createDataFrame([(i, t, [1]) for i, t in docs], "doc_id long, text string, matches array<int>").repartition(2)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: {m["item_id"]: m["distance"] for m in r["matches"]} for r in decontaminate.matched(df, table).collect()}
    for i, text in docs:
        want = {}
        for j, item in items:
            if item:
                raw = decontaminate.lowered(item)
                if (d := _distance(raw, decontaminate.lowered(text or ""))) <= (decontaminate.budget(raw) if len(raw) >= 8 else 0):
                    want[j] = d
        assert got[i] == want, (i, text)
    kept = decontaminate.clean(df.drop("matches"), table)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in got if not got[i])
    assert decontaminate.matched(df.limit(0), table).collect() == []


# --- PII ------------------------------------------------------------------------------------------


def _plain(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text("ab1234567890@@..--++() %_é\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert sorted(pii.base_spans(text)) == sorted(_plain(text))


def test_viterbi_equals_the_best_of_all_paths():
    from itertools import product

    rng = np.random.default_rng(2)
    chain = crf.Chain(np.vstack([rng.normal(size=(5, 3)), np.zeros(3)]), rng.normal(size=(3, 3)), rng.normal(size=3))
    chains = [[[int(rng.integers(5))] for _ in range(n)] for n in (1, 2, 4, 5)]
    for c, got in zip(chains, chain.viterbi(chains), strict=True):
        score = lambda p: chain.first[p[0]] + sum(chain.emit[f[0], y] for f, y in zip(c, p, strict=True)) + sum(chain.move[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        assert tuple(got) == max(product(range(3), repeat=len(c)), key=score)


def test_chain_adds_what_patterns_miss():
    texts = ["call (017) 555-7713 now", "cards 7536784127813050 4845168114407329 here", "version 3.0 of 2024-01-05, 12:30", "no 1234567812345678 id", "", "a.34@mail7.example.com"]
    found = pii.all_spans(texts, pii.model())
    assert ("phone", 5, 19) in found[0][1] and not found[0][0]
    assert all(k == "card" for k, _, _ in found[1][1])
    assert found[2][1] == found[4][1] == []
    assert found[5][0] == found[5][1] == [("email", 0, 22)]
    rows = pii.labelled_table(8, seed=99)
    got = pii.all_spans([t for t, _ in rows], pii.model())
    assert sum(set(s) == set(a) for (_, s), (_, a) in zip(rows, got, strict=True)) / len(rows) > 0.9


def test_find_and_redact(spark):
    texts = [None, "", "x 10.0.0.1 é a@b.co y", "1" * 100_000 + "@", "x 10.0.0.1 é a@b.co y"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    assert got[2]["spans"] == "email:13:19,ip:2:10" and got[2]["n_email"] == got[2]["n_ip"] == 1
    assert got[2]["base_sha256"] == hashlib.sha256(b"email:13:19,ip:2:10").hexdigest() and got[0]["spans"] == got[3]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[2] == "x <IP> é <EMAIL> y" and clean[0] is None and clean[1] == ""
    assert pii.find(df.limit(0)).collect() == []


# --- media ----------------------------------------------------------------------------------------


def _one_block(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            delta = step >> 3
            for bit, shift in ((4, 0), (2, 1), (1, 2)):
                delta += step >> shift if code & bit else 0
            value = max(-32768, min(32767, value - delta if code & 8 else value + delta))
            index = max(0, min(88, index + int(media.INDEX_MOVE[code & 7])))
            out.append(value)
    return out


def test_codecs():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (7, media.BLOCK), dtype=np.uint8)
    assert media.adpcm_decode(blocks).tolist() == [_one_block(bytes(b)) for b in blocks]
    assert media.MULAW_PCM[[0, 0x80, 0xFF]].tolist() == [-32124, 32124, 0]
    assert media.ALAW_PCM[[0x55, 0xD5, 0xAA, 0x2A]].tolist() == [-8, 8, 32256, -32256]
    for codec in media.CODECS:
        assert media.from_file(media.to_file(bytes(range(64)), codec))[::2] == (codec, bytes(range(64)))
    assert media.from_file(b"") is None and media.from_file(media.to_file(bytes(64), 7)[:-1]) is None
    assert media.resample(np.array([0, 10, 20], np.int16), 1, 2).tolist() == [0, 5, 10, 15, 20, 20]


def test_store_and_load(spark):
    texts = [None, "", "é" * 32, "a" * 65, "a" * 65, "long " * 30_000]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    sounds = media.load(media.store(df), keep=("doc_id", "n_bytes"))
    got = {r["doc_id"]: {**r.asDict(), **f.asDict()} for r, f in zip(sounds.orderBy("doc_id").collect(), media.described(sounds).orderBy("doc_id").collect(), strict=True)}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert len(r["pcm"]) == 2 * int(re.search(r" n=(\d+)", r["feature"])[1])
    assert got[3]["feature"] == got[4]["feature"] and got[3]["media_sha256"] == got[4]["media_sha256"]
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"RIFF"))], "doc_id long, media binary")
    assert [r["feature"] for r in media.described(media.load(odd)).collect()] == [None, None]
    assert media.described(media.load(media.store(df.limit(0)))).count() == 0


def test_stored_sound_is_what_features_are_of(spark):
    """A low rate keeps every second sample, of whole blocks and of the last."""
    text = "sound " * 50
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = media.load(media.store(df, codec=media.MULAW), rate=4000).first()
    payload = media.pad(text.encode())
    want = media.MULAW_PCM[np.frombuffer(payload, np.uint8)][::2]
    assert np.frombuffer(row["pcm"], "<i2").tolist() == want.tolist()
    assert media.described(media.load(media.store(df, codec=media.MULAW), rate=4000), 4000).first()["feature"] == media.feature("mulaw", want, 4000)


# --- WARC -----------------------------------------------------------------------------------------


def test_archives_and_index(spark):
    rows = [(3, "http://a.b.example.com/x?y", "zz"), (1, "https://example.com/q", "zz"), (2, None, None), (5, "odd\r\nx", ""), (7, "http://example.com/q", "é only"), (None, "u", "zz"), (1, "https://example.com/q", "zz"), (9, "http://example.com/long", "x" * 200_000)]
    df = spark.createDataFrame([(*r, "k", 4) for r in rows], "page_id long, url string, html string, key string, offset int").repartition(3)
    for least, empty in ((0, "revisit"), (1, "response")):
        segments = warc.build_index(warc.write(df, least), lines=2)
        got = sorted(map(tuple, warc.read(warc.look_up(warc.url_keys(df), segments)).collect()), key=repr)
        want = []
        for page, _, html in rows:
            raw = (html or "").encode()
            revisit = page in (3, None) or page == 5 and empty == "revisit"
            want.append((page, len(raw), warc.digest_of(raw), "revisit" if revisit else "response", (2 if page == 5 else 1) if revisit else None))
        assert got == sorted(want, key=repr)
    hits = warc.find(segments, ["http://example.com/q", "http://nope/", "http://a.b.example.com/x?y"])
    assert sorted(x[1] for x in hits["http://example.com/q"]) == [1, 1, 7] and hits["http://nope/"] == [] and len(hits["http://a.b.example.com/x?y"]) == 1
    fields, block = warc.fetch(*next(x for x in hits["http://example.com/q"] if x[1] == 7)[3:])
    assert fields["warc-type"] == "response" and block.endswith("é only".encode())
    assert warc.url_key("http://www.example.com:80/a?b#c") == "com,example,www:80)/a?b"
    none = warc.build_index(warc.write(df.limit(0)))
    assert warc.read(warc.look_up(warc.url_keys(df), none)).collect() == [] and warc.find(none, ["u"]) == {"u": []}


def test_a_key_over_many_blocks_and_segments(spark):
    """A URL of a third of all captures: its lines fill many blocks, and tasks sort parts of them."""
    rows = [(i, "http://hot.example/" if i % 3 == 0 else f"http://h{i}.example/", f"p{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        segments = warc.build_index(warc.write(df), lines=7)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert segments.count() > 1 and segments.agg({"lines": "sum"}).first()[0] == 300
    assert sorted(x[1] for x in warc.find(segments, ["http://hot.example/"])["http://hot.example/"]) == list(range(0, 300, 3))
    assert sorted(r["page_id"] for r in warc.look_up(warc.url_keys(df), segments).collect()) == list(range(300))
