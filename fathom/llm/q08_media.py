"""op8: every whole text of ``documents`` stored as a telephony sound file, read back, and decoded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import media
from fathom.llm._storage import discard, kept

NAME = "op8_media_columns"
ORACLE_SQL = None


#: Samples a second of the stored sound: what ``load`` gives unless told, and what narrow- and wideband tools read.
RATE = 16000
#: Documents are stored and read back in so many parts, one after the other: files and sound of one part alone lie on disk.
PARTS = 4


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables are written and read back for each part: the files, and the resampled sound that features are taken of."""
    documents, found = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for n in range(PARTS):
        stored = kept(media.store(documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)) == n)), "media")
        sounds = kept(media.load(stored, keep=("doc_id", "n_bytes"), rate=RATE), "sounds")
        discard(stored)
        found.append(kept(media.described(sounds, RATE), "features"))
        discard(sounds)
    return reduce(DataFrame.unionByName, found)
