"""Texts that contain others, by an index of n-grams or by one automaton, without comparing all with all."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def grams(text: Column, n: int) -> Column:
    """The distinct n-grams of a text; none for a shorter one."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(n))))


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is not to be sent to all tasks: Spark goes by the compressed bytes of a shuffle, while the
    table that the driver makes of short rows to send them is up to fifty times as large."""
    return df.hint("merge")


def contained(needles: DataFrame, hay: DataFrame, needle: str = "needle", text: str = "text") -> DataFrame:
    """(needle, text): the distinct texts of ``hay`` that contain each needle as it stands. Null and empty needles are in none.

    The grams of all texts are postings; a needle looks up the one of its grams that the fewest texts have, and only those
    texts are searched. Grams have GRAM characters, and fewer for needles that are shorter. A needle with a gram that no text has ends there."""
    texts = hay.select(text).where(F.col(text).isNotNull()).distinct()
    asked = needles.select(needle).where(F.coalesce(F.col(needle), F.lit("")) != "").distinct()
    size = F.least(F.length(needle), F.lit(GRAM))
    asked = asked.withColumn("gram", F.explode(F.when(size == 1, grams(F.col(needle), 1)).when(size == 2, grams(F.col(needle), 2)).otherwise(grams(F.col(needle), GRAM))))
    postings = texts.select(text, F.explode(F.concat(*[grams(F.col(text), n) for n in range(1, GRAM + 1)])).alias("gram"))
    postings = postings.join(asked.select("gram").distinct(), "gram", "left_semi")  # grams that no needle has are dropped before the shuffle where needles are few
    counts = postings.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, "gram", "left").groupBy(needle).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    rarest = rarest.where("r.n > 0").select(needle, F.col("r.gram").alias("gram"))
    return rarest.join(shuffled(postings), "gram").where(F.contains(F.col(text), F.col(needle))).select(needle, text)


#: Bytes of names up to which one automaton goes to every task.
MOST_BYTES = 64 << 20


def mentions(docs: DataFrame, names: DataFrame, key: str = "chunk_id", text: str = "content", id_: str = "id", name: str = "name", most: int = MOST_BYTES) -> DataFrame:
    """(key, id) of the documents that mention a name of an id anywhere, all case ignored and names without outer blanks.

    Names of up to ``most`` bytes, which is checked, make one Aho-Corasick automaton, by which a document is read once however
    many names there are; more are looked up by their grams. Documents and ids may repeat; pairs do not, within a document's row."""
    wanted = names.select(F.col(id_).alias("id"), F.lower(F.trim(name)).alias("name")).where(F.coalesce("name", F.lit("")) != "").distinct()
    rows = docs.select(key, F.lower(text).alias("text"))
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("name") + 16), F.lit(0))).first()[0]
    if size > most:
        found = contained(wanted, rows, "name", "text").join(shuffled(wanted), "name").select("text", "id").distinct()
        return rows.join(shuffled(found), "text").select(key, "id")
    import ahocorasick

    automaton, ids, kind = ahocorasick.Automaton(), {}, names.schema[id_].dataType.simpleString()
    for r in wanted.collect():
        ids.setdefault(r["name"], []).append(r["id"])
    for n, (word, own) in enumerate(ids.items()):
        automaton.add_word(word, (n, own))
    if not ids:
        return rows.sparkSession.createDataFrame([], f"`{key}` {docs.schema[key].dataType.simpleString()}, id {kind}")
    automaton.make_automaton()
    held = rows.sparkSession.sparkContext.broadcast(automaton)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = held.value
        for batch in batches:
            at, out = [], []
            for row, t in enumerate(batch.column(1)):
                words = {n: own for _, (n, own) in find.iter(t.as_py())} if t.is_valid else {}
                for i in dict.fromkeys(i for own in words.values() for i in own):
                    at.append(row)
                    out.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(out, schema)], [key, "id"])

    from pyspark.sql.pandas.types import to_arrow_type

    schema = to_arrow_type(names.schema[id_].dataType)
    return rows.mapInArrow(work, f"`{key}` {docs.schema[key].dataType.simpleString()}, id {kind}")
