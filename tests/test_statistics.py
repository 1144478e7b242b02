"""Statistics of several loads beside one fit over all; loads cut off, repeated and taken back."""

import random

from fathom.plans import statistics
from fathom.plans.retrieval import build_index
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F


def test_loads_merge(spark, tmp_path, monkeypatch):
    rng, path = random.Random(3), f"{tmp_path}/stats"
    text = lambda: " ".join(f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 60)))
    parts = [[(f"{n}-{i}", text()) for i in range(150)] for n in range(3)]
    frame = lambda rows: spark.createDataFrame(rows, "chunk_id string, content string")
    real = DataFrameWriter.parquet

    def cut(self, where, *more, **options):
        if "/loads/" in where:
            raise OSError("cut off")
        return real(self, where, *more, **options)

    assert statistics.add(frame(parts[0]), path, "first/load")
    monkeypatch.setattr(DataFrameWriter, "parquet", cut)
    try:
        statistics.add(frame(parts[1][:50]), path, "second")
    except OSError:
        pass
    monkeypatch.setattr(DataFrameWriter, "parquet", real)
    assert statistics.loads(spark, path) == {"first/load"}
    assert statistics.add(frame(parts[1]), path, "second") and not statistics.add(frame(parts[1]), path, "second")
    statistics.add(frame(parts[2]), path, "third")
    statistics.add(frame(parts[0][:20]), path, "back", taken_back=True)
    left = parts[0][20:] + parts[1] + parts[2]
    index = build_index(frame(left))
    rows = lambda df: sorted((r["term"], r["df"], round(r["idf"], 9)) for r in df.collect())
    terms, stats = statistics.model(spark, path)
    assert rows(terms) == rows(index.terms) and round(stats.first()["avgdl"], 9) == round(index.stats.first()["avgdl"], 9)
    sizes = sorted(len(t.split()) for rows in parts for _, t in rows)
    for r in statistics.length_quantiles(spark, path, [0.1, 0.5, 0.9]).collect():
        low, high = sum(s < r["length"] for s in sizes) / len(sizes), sum(s <= r["length"] for s in sizes) / len(sizes)
        assert low - 0.02 <= r["q"] <= high + 0.02
    assert index.stats.select(F.col("num_docs")).first()[0] == len(left)
