"""Values that expire, beside a plain loop over batches and watermarks."""

import datetime as dt
import random

from fathom.streaming import expiry

T0 = dt.datetime(2024, 1, 1)


def plain(batches, days, late):
    held, mark, out = {}, None, []
    for rows in batches:
        for key in sorted({r[0] for r in rows if r[0] and r[1]}):
            best = max((t, v or "") for k, t, v in rows if k == key and t)
            if key not in held or held[key] < best:
                held[key] = best
                out.append((key, *best, "kept"))
        top = max([t for k, t, _ in rows if k and t] + ([] if mark is None else [mark + late]), default=None)
        mark = None if top is None else top - late
        for key, best in list(held.items()):
            if mark is not None and best[0] + days <= mark:
                del held[key]
                out.append((key, *best, "expired"))
    return sorted(out)


def test_equals_a_plain_loop_at_each_watermark(spark, tmp_path):
    rng = random.Random(2)
    batches = []
    for b in range(4):
        rows = [(rng.choice(["hot", "hot", *"abcdefgh", None]), T0 + dt.timedelta(days=4 * b, seconds=rng.randrange(400_000), microseconds=rng.randrange(10**6)), rng.choice(["x", "y", None])) for _ in range(60)]
        batches.append([*rows, ("a", None, "x"), *rows[:5]])
    schema, source = "k string, ts timestamp, v string", f"{tmp_path}/in"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        with expiry.rocks(spark):
            out = expiry.latest(stream, "k", "v", 3, "12 hours")
            out.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    assert "HDFSBacked" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r["key"], dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=r["us"]), r["value"], r["state"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = plain(batches, dt.timedelta(days=3), dt.timedelta(hours=12))
    assert got == want and {r[3] for r in want} == {"kept", "expired"}
