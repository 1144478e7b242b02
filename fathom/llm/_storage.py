"""Tables and files in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of this machine for a local session, as in tests; an error on a cluster."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("fathom.shared.dir", None)
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        held = f"file://{tempfile.mkdtemp(prefix='fathom-')}"
        spark.conf.set("fathom.shared.dir", held)
    return held.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: With it on, a write removes the shuffle files of its own plan once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written to a new table in the shared folder and read from there: its lineage ends, its shuffle
    files go, and a lost executor costs no more than its tasks. The session's settings stay as they were."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables made by ``kept`` that no plan still to be run reads; others, and null, are left alone."""
    for df in tables:
        if (path := getattr(df, "kept_at", None)) is not None:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            df.kept_at = None


#: Buckets of keys that one number of parts is kept for: a table of so many rows at most is sent to all tasks.
BUCKETS = 1 << 16
#: Rows of one key beyond which they are dealt to several tasks, and the most parts.
HOT, PARTS = 1000, 4096


def salted_join(many: DataFrame, one: DataFrame, key: str, by: list[str], n: str = "n", hot: int = HOT) -> DataFrame:
    """``many`` joined with ``one``, which has a row for each key and in ``n`` how many rows of ``many`` that key has.

    A key of over ``hot`` rows is dealt to as many parts as it has multiples of that, picked by the columns ``by``; its
    row in ``one`` goes to each. How many parts is told by bucket of keys, so that the telling is a table of BUCKETS rows at most."""
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("_bucket")
    parts = one.where(F.col(n) > hot).groupBy(bucket).agg(F.least(F.ceil(F.max(n) / hot), F.lit(PARTS)).cast("int").alias("_parts"))
    tell = lambda df: df.withColumn("_bucket", bucket).join(F.broadcast(parts), "_bucket", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    left = tell(many).withColumn("_part", F.pmod(F.xxhash64(*by), F.col("_parts").cast("long")).cast("int")).drop("_bucket", "_parts")
    right = tell(one).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_bucket", "_parts")
    return left.join(right, [key, "_part"]).drop("_part")


def renamed(df: DataFrame, needed: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with all columns but those ``needed`` under names that no operator uses, and the way back to the columns as they
    were, in their order. So no extra column clashes with an operator's own, not even by its letters' case."""
    names = df.columns
    inner = [c if c in needed else f"_extra_{i}" for i, c in enumerate(names)]
    return df.toDF(*inner), lambda out: out.select(*inner).toDF(*names)
