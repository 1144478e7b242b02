"""Keyed tables with versions: an upsert writes the buckets of keys that it changes and then a new manifest.

A table is a folder. ``data/<write>/bucket=<n>`` holds the rows of one bucket of key hashes as one upsert has written them,
and ``versions/<number>.json`` names the folder of every bucket. A version appears whole when its manifest does, which is
the last step; until then, and after a failure at any place, readers see the version before. Buckets that an upsert does not
change keep their files. Old versions stay readable until ``vacuum`` removes the folders that none of the last ones names.

Two writers cannot make the same version: the second finds the number taken and its upsert ends in an error, to be run again."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fathom.operators.keyed import last_by_key
from fathom.sinks import discard, materialized, store

#: Buckets of a new table. A bucket is rewritten whole, so there should be enough for one to be a task's work.
BUCKETS = 64
BUCKET = "bucket"


class Conflict(RuntimeError):
    """Another writer has made the version."""


@dataclass(frozen=True)
class Version:
    number: int
    schema: str
    keys: list[str]
    buckets: int
    files: dict[str, str] = field(default_factory=dict)
    #: By source, the last batch that has been merged.
    applied: dict[str, int] = field(default_factory=dict)


def location(spark: SparkSession, table: str) -> str:
    """The folder of a table: the name itself if it is a path, else a folder of that name in the warehouse."""
    return table if "/" in table else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{table}.versions"


def version(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """The last version, or the one asked for; null where there is none."""
    numbers = [int(n[:-5]) for n in store.names(spark, f"{path}/versions") if n.endswith(".json") and n[:-5].isdigit()]
    wanted = max(numbers, default=None) if number is None else number
    return Version(**json.loads(store.read_text(spark, f"{path}/versions/{wanted:010}.json"))) if wanted in numbers else None


def read(spark: SparkSession, path: str, number: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The rows of the last version, or of the one asked for; ``only`` reads some buckets."""
    at = version(spark, path, number)
    if at is None:
        raise FileNotFoundError(f"{path} has no version{'' if number is None else f' {number}'}")
    schema = StructType.fromJson(json.loads(at.schema))
    folders = [f"{path}/{f}" for b, f in at.files.items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert(new: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS, batch: tuple[str, int] | None = None) -> Version:
    """Merges rows by key, the last by ``seq`` counting where there is that column; null is a key like others.

    Rows that are there already as they are change nothing, and an upsert without changes makes no version. batch: a source
    and the number of its batch; one that has been merged, or an earlier one, is left out. Columns must be those of the table."""
    spark, at = new.sparkSession, version(new.sparkSession, path)
    if batch and at and at.applied.get(batch[0], -1) >= batch[1]:
        return at
    fresh = last_by_key(new, keys, "seq").drop("seq") if "seq" in new.columns else new.dropDuplicates(keys)
    if at is None:
        at = Version(-1, json.dumps(fresh.schema.jsonValue()), list(keys), buckets)
    schema = StructType.fromJson(json.loads(at.schema))
    if at.keys != list(keys) or set(schema.names) != set(fresh.columns):
        raise ValueError(f"the table has keys {at.keys} and columns {schema.names}")
    fresh = fresh.select(*[F.col(f.name).cast(f.dataType) for f in schema])
    bucket = F.pmod(F.xxhash64(*keys), F.lit(at.buckets)).cast("int").alias(BUCKET)
    fresh = asked_for = materialized(fresh.select("*", bucket), "upsert")
    asked = [r[0] for r in fresh.select(BUCKET).distinct().collect()]
    old = read(spark, path, only=asked).select("*", bucket) if at.files else fresh.limit(0)
    same = [fresh[k].eqNullSafe(old[k]) for k in [BUCKET, *keys]]
    if "map<" not in schema.simpleString():  # maps cannot be compared: with one, all rows count as changed
        alike = [*same, *[fresh[c].eqNullSafe(old[c]) for c in schema.names if c not in keys]]
        fresh = materialized(fresh.join(old, alike, "left_anti"), "upsert")
        same = [fresh[k].eqNullSafe(old[k]) for k in [BUCKET, *keys]]
    touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]
    if not touched and not batch and at.number >= 0:
        discard(fresh, asked_for)
        return at
    files = dict(at.files)
    if touched:
        write = f"data/{uuid.uuid4().hex}"
        merged = old.where(F.col(BUCKET).isin(touched)).join(fresh, same, "left_anti").unionByName(fresh)
        merged.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/{write}")
        files |= {str(b): f"{write}/{BUCKET}={b}" for b in touched}
    discard(fresh, asked_for)
    made = Version(at.number + 1, at.schema, at.keys, at.buckets, files, at.applied | ({batch[0]: batch[1]} if batch else {}))
    if not store.put_new(spark, f"{path}/versions/{made.number:010}.json", json.dumps(asdict(made))):
        raise Conflict(f"version {made.number} of {path} has been made by another writer")
    return made


def vacuum(spark: SparkSession, path: str, last: int = 2) -> list[str]:
    """Removes manifests before the ``last`` ones, and folders that none of those names, also what cut-off writes left. No write may be under way."""
    numbers = sorted(int(n[:-5]) for n in store.names(spark, f"{path}/versions") if n.endswith(".json"))
    named = {f.split("/")[1] for n in numbers[-last:] for f in version(spark, path, n).files.values()}
    for n in numbers[:-last]:
        store.delete(spark, f"{path}/versions/{n:010}.json")
    gone = [w for w in store.names(spark, f"{path}/data") if w not in named]
    for w in gone:
        store.delete(spark, f"{path}/data/{w}")
    return gone
