"""The pipeline's stages on a small table: each decision takes effect, and clean documents stay."""

import hashlib
import random

import corpus_pipeline
import public_tokenizers
import tiktoken

from fathom.llm import bpe, decontaminate, pii
from fathom.llm._storage import kept


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    item = prose(40)
    docs = {i: prose(rng.randint(30, 80)) for i in range(120)}
    docs |= {200 + i: " ".join(w + "$$$" for w in prose(40).split()) for i in range(60)}
    docs |= {300: docs[3], 301: docs[4] + " one", 302: prose(20) + " " + item + " " + prose(20), 303: "mail a.1@b.example.com " + prose(30)}
    labels = [(i, int(i < 200), 0) for i in docs if i < 300 and i % 2]
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = kept(stage(spark, now, str(tmp_path)), name)
        seen[name] = {r["doc_id"]: r for r in now.collect()}
        if name != "byte_bpe":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(seen["quality"]) == {i for i in docs if not 200 <= i < 300}
    assert set(seen["ngram_jaccard"]) == set(seen["quality"]) - {300, 301}
    assert set(seen["decontaminate"]) == set(seen["ngram_jaccard"]) - {302}
    assert seen["pii"][303]["text"].startswith("mail <EMAIL> ") and seen["pii"][303]["n_chars"] == len(seen["pii"][303]["text"])
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for i, r in seen["byte_bpe"].items():
        want = own.encode_ordinary(pii.masked(docs[i], pii.all_spans([docs[i]], pii.model())[0][1]))
        assert list(r["ids"]) == want and r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(seen["byte_bpe"])
    assert decontaminate.budget(b"x" * 16) == 1
