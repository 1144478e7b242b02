"""How rows lie before expressions that cost more than reading them."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A plan of more bytes is read in splits enough for any cluster; a smaller one may be a single row group, which is one task.
SMALL = 1 << 30
#: Bytes, by Spark's estimate, of the rows that are dealt to one task.
DEALT = 32 << 20


def _size(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def dealt(df: DataFrame) -> int | None:
    """How many tasks ``df`` is to be dealt to: all cores, and more as it grows; none where Spark has no estimate, which it
    tells by a size beyond any table's. A number is named, as Spark would join small tasks by the bytes of the rows as they are read."""
    size = _size(df)
    return None if size >= 1 << 50 else max(df.sparkSession.sparkContext.defaultParallelism, -(-size // DEALT))


def spread(df: DataFrame, fine: bool = False) -> DataFrame:
    """``df`` dealt to all cores if it is small, which Spark's own estimate tells without a run, or, if ``fine``, to as many tasks as
    ``dealt`` tells, of which all cores have equally many. Rows and results are the same."""
    if _size(df) > SMALL:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(-(-dealt(df) // cores) * cores if fine else cores)


def spread_by(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by a key to all cores and to more tasks as it grows, so that what is made of a row can be grouped by the key
    and other columns where it is made."""
    tasks = dealt(df)
    return df.repartition(key) if tasks is None else df.repartition(tasks, key)
