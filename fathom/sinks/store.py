"""Small files of the driver in whatever store Spark's paths name."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _place(spark, path)
    return system.exists(place)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder holds, in order; none for a folder that is not there."""
    system, place = _place(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    system, place = _place(spark, path)
    stream = system.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that appears whole or not at all; whether it did: false where one of that name is there already."""
    system, place = _place(spark, path)
    _, aside = _place(spark, f"{path}.{spark._jvm.java.util.UUID.randomUUID()}.aside")
    stream = system.create(aside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    done = not system.exists(place) and system.rename(aside, place)
    if not done:
        system.delete(aside, False)
    return done


def delete(spark: SparkSession, path: str) -> None:
    system, place = _place(spark, path)
    system.delete(place, True)
