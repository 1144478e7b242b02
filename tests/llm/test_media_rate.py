"""The sound of op8 holds every sample of its file: two for each of 8000 a second."""

from fathom.llm import q08_media


def test_sound_is_stored_at_the_full_rate(spark):
    rows = q08_media.query(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    for r in rows:
        codec, rate, n = r["feature"].split()[:3]
        samples = r["payload_bytes"] // 64 * 121 if codec == "adpcm" else r["payload_bytes"]
        assert (rate, n) == ("rate=16000", f"n={2 * samples}")
