"""Panes beside a plain loop over batches; batches cut off and run again; odd rows."""

import datetime as dt
import random
import zlib

import pytest
from pyspark.sql import DataFrameWriter

from fathom.llm import panes, q13_panes

DAY = dt.timedelta(days=1)
EPOCH = dt.datetime(1970, 1, 1)
SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, batch string"


def plain(rows, batches=8):
    """rows: (batch, click_id, kind, us, cents)."""
    top, open_, out = None, {}, []
    for b in range(batches):
        mine = [r for r in rows if r[0] == b]
        gone = lambda hour, after: top is not None and top >= (hour + 1) * panes.HOUR + after  # noqa: B023, E731
        changed = {}
        for _, click, kind, us, cents in mine:
            hour = us // panes.HOUR
            if gone(hour, panes.CLOSED):
                out.append((b, "late", kind, hour, click, 1, cents))
                continue
            n, c = changed.get((kind, hour), (0, 0))
            changed[kind, hour] = (n + 1, c + cents)
        for key, (n, c) in changed.items():
            old_n, old_c, published = open_.get(key, (0, 0, False))
            open_[key] = (old_n + n, old_c + c, published)
            if published:
                out += [(b, "retract", *key, -1, old_n, old_c), (b, "replace", *key, -1, old_n + n, old_c + c)]
        for key, (n, c, published) in list(open_.items()):
            if not published and gone(key[1], panes.DUE):
                out.append((b, "emit", *key, -1, n, c))
                open_[key] = (n, c, True)
            if gone(key[1], panes.CLOSED):
                del open_[key]
        top = max([r[3] for r in mine] + ([] if top is None else [top]), default=None)
    out += [(batches - 1, "final", *key, -1, n, c) for key, (n, c, published) in open_.items() if not published]
    return sorted(out, key=repr)


def made(seed=4, n=1500, empty=(3,)):
    """A third of the rows is of one kind and hour; batch 3 is empty; times reach far below 1970."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        b = rng.choice([x for x in range(8) if x not in empty])
        us = b * 24 * panes.HOUR + rng.randrange(24 * panes.HOUR) - rng.choice([0, 0, 0, 10, 60, 200, 10**6]) * panes.HOUR
        if i % 3 == 0:
            us = 30 * panes.HOUR + i
        rows.append((b, i, rng.choice(["a", "b", "none"]), us, rng.randrange(-500, 500)))
    rows.append((0, n, "a", 0, 1))
    rows.append((5, n + 1, "a", 24 * 5 * panes.HOUR, 7))  # on the boundary of an hour
    return rows


SHAPE = "batch int, click_id long, kind string, us long, cents long"


def read(df):
    return sorted(map(tuple, df.select("batch", "record", "kind", "hour", "click_id", "n_rows", "cents").collect()), key=repr)


@pytest.mark.parametrize("empty", [(3,), (0, 7)])
def test_equals_a_plain_loop(spark, empty):
    rows = made(empty=empty)
    rows = [r for r in rows if r[0] not in empty]
    assert read(panes.run(spark.createDataFrame(rows, SHAPE).repartition(3), 8)) == plain(rows)


def test_no_rows_at_all(spark):
    assert panes.run(spark.createDataFrame([], SHAPE), 8).collect() == []


def test_batches_cut_off_are_run_again(spark, tmp_path, monkeypatch):
    """A failure before a batch's records, between its records and its panes, and after all was written; each is then fed again."""
    rows = made(seed=9, n=400)
    folder = str(tmp_path / "panes")
    spark.createDataFrame(rows, SHAPE).write.partitionBy("batch").parquet(f"{folder}/staged")
    write = DataFrameWriter.parquet
    for b in range(8):
        panes.deliver(spark, f"{folder}/staged", folder, b)
        panes.deliver(spark, f"{folder}/staged", folder, b)  # a delivery that is repeated does nothing
        for place in {2: ["/changes/2"], 5: ["/out/batch=5", "/top/5", "/panes/5"]}.get(b, []):

            def cut(self, path, *more, place=place, **options):
                if path.endswith(place):
                    raise OSError("cut off")
                return write(self, path, *more, **options)

            monkeypatch.setattr(DataFrameWriter, "parquet", cut)
            with pytest.raises(Exception, match="cut off"):
                panes.feed(spark, folder, b, b == 7)
            monkeypatch.setattr(DataFrameWriter, "parquet", write)
        panes.feed(spark, folder, b, b == 7)
        if b == 4:
            panes.feed(spark, folder, b, b == 7)  # nothing new: its records stay
    assert read(spark.read.schema(panes.OUT).parquet(f"{folder}/out")) == plain(rows)


def test_rows_of_clicks(spark):
    """Repeats count once; a null kind is none, a null or broken value 0; null ts goes; null arrival is the time of the click."""
    ts = dt.datetime(2024, 1, 3, 5, 30, 0, 123456)
    base = [
        (1, ts, ts + DAY, 1, "view", 1.005, "{}", "x"), (1, ts, ts + DAY, 1, "view", 1.005, "{}", "x"), (2, None, ts, 1, "view", 1.0, "{}", "x"),
        (3, ts, None, 1, None, None, None, "x"), (4, ts, ts, None, "click", float("nan"), "", "x"), (5, ts, ts, 1, "click", 1e300, "", "x"),
        (6, dt.datetime(1969, 1, 1), ts, 1, "click", -2.345, "", "x"), (None, ts, ts, 1, "view", 2.5, "", "x"), (None, ts, ts, 1, "view", 2.5, "", "x"),
    ]
    got = sorted(map(tuple, q13_panes.batched(spark.createDataFrame(base, SCHEMA)).select("batch", "click_id", "kind", "us", "cents").collect()), key=repr)
    want = []
    for i, t, arrived, _, kind, value, *_ in {r[0]: r for r in base}.values():
        if t is None:
            continue
        d = ((arrived or t) - EPOCH).days
        extra = max(0, zlib.crc32(str(i).encode()) % 30 - 23) if i is not None else 0
        us = (t - EPOCH) // dt.timedelta(microseconds=1) - (d - d % 8) * 24 * panes.HOUR
        cents = 0 if value is None or value != value or value > 1e200 else int((100 * value + 0.5) // 1)
        want.append((min(7, d % 8 + extra), i, kind or "none", us, cents))
    assert got == sorted(want, key=repr)
