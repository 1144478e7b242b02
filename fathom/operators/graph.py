"""Property graphs of threat reports: bundles to nodes and edges, matches of names, two-hop traversals, alias closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.text import TECHNIQUE, technique
from fathom.operators.substrings import contained, shuffled


def is_active(revoked: Column, deprecated: Column) -> Column:
    return ~F.coalesce(revoked, F.lit(False)) & ~F.coalesce(deprecated, F.lit(False))


def has_tactic(phases: Column, tactic: Column) -> Column:
    """Whether any kill-chain phase has the tactic's name; a null tactic fits all."""
    return tactic.isNull() | F.coalesce(F.exists(phases, lambda p: p["phase_name"] == tactic), F.lit(False))


def match_names(queries: DataFrame, names: DataFrame, query: str = "query", name: str = "name") -> DataFrame:
    """(query, id, mode): an exact name, else an exact alias, else the only one with an alias that contains the query.

    names: id, ``name``, aliases, position (which of several exact matches comes first). All comparisons ignore
    case and outer blanks. Modes: exact_name, exact_alias, alias_contains, alias_ambiguous, no_match. Neither side of a join
    is bounded, so none is sent to all tasks."""
    q = queries.select(F.col(query).alias("query"), F.lower(F.trim(F.coalesce(F.col(query), F.lit("")))).alias("key")).distinct()
    n = names.select("id", "position", F.lower(F.trim(F.col(name))).alias("name"), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(F.trim(a))).alias("aliases"))
    alias = n.select("id", "position", F.explode("aliases").alias("alias"))
    first = lambda df, mode: df.groupBy("query").agg(F.min_by("id", "position").alias("id"), F.lit(1).alias("hits")).withColumn("mode", F.lit(mode))
    by_name = first(q.join(shuffled(n), q["key"] == n["name"]), "exact_name").withColumn("priority", F.lit(0))
    by_alias = first(q.join(shuffled(alias), q["key"] == alias["alias"]), "exact_alias").withColumn("priority", F.lit(1))
    open_ = q.where("key <> ''").join(shuffled(by_name.select("query")), "query", "left_anti").join(shuffled(by_alias.select("query")), "query", "left_anti")
    pairs = open_.join(shuffled(contained(open_, alias, "key", "alias")), "key").join(shuffled(alias), "alias")
    inside = pairs.groupBy("query").agg(F.min_by("id", "position").alias("id"), F.count_distinct("id").alias("hits"))
    by_part = inside.select("query", F.when(F.col("hits") == 1, F.col("id")).alias("id"), "hits", F.when(F.col("hits") == 1, "alias_contains").otherwise("alias_ambiguous").alias("mode"), F.lit(2).alias("priority"))
    found = by_name.unionByName(by_alias).unionByName(by_part)
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("priority"))).where("n = 1").select("query", "id", "mode")
    return q.select("query").join(shuffled(best), "query", "left").select("query", "id", F.coalesce("mode", F.lit("no_match")).alias("mode"))


#: Paths from actors to techniques that one task groups.
TOGETHER = 1 << 20


def gold_techniques(actors: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(actor, tactic, technique, direct, via_software): active techniques used by an actor or by software that it uses.

    actors: actor (a node id), tactic (or null). nodes: id, type, external_id, phases, revoked, deprecated. edges: src, rel,
    dst; edges to missing nodes fall out in the joins. What a node uses is one list in the joins, and lists are opened where
    their actor's rows have met, by as many tasks as their length asks for: Spark goes by the bytes of lists that are not opened."""
    node = nodes.select(F.col("id").alias("dst"), "type", "external_id", "phases", "revoked", "deprecated")
    uses = edges.where("rel = 'uses'").select("src", "dst").distinct().join(node, "dst")
    to_technique = uses.where((F.col("type") == "attack-pattern") & is_active(F.col("revoked"), F.col("deprecated")))
    to_technique = to_technique.where(F.col("external_id").rlike(f"(?i)^{TECHNIQUE}$")).select("src", technique(F.col("external_id")).alias("technique"), "phases").distinct()
    found = to_technique.groupBy("src").agg(F.collect_list(F.struct("technique", "phases")).alias("found"))
    to_software = uses.where(F.col("type").isin("malware", "tool")).select(F.col("src").alias("actor"), F.col("dst").alias("src"))
    direct = actors.join(found.withColumnRenamed("src", "actor"), "actor").withColumn("hop", F.lit(1))
    via = actors.join(to_software, "actor").join(found, "src").drop("src").withColumn("hop", F.lit(2))
    fits = F.transform(F.filter("found", lambda f: has_tactic(f["phases"], F.col("tactic"))), lambda f: f["technique"])
    lists = _table(direct.unionByName(via).select("actor", "tactic", "hop", fits.alias("techniques")).where(F.size("techniques") > 0))
    made = lists.agg(F.sum(F.size("techniques"))).first()[0] or 0
    parts = max(lists.sparkSession.sparkContext.defaultParallelism, -(-made // TOGETHER))
    rows = lists.repartition(parts, "actor").select("actor", "tactic", "hop", F.explode("techniques").alias("technique"))
    return rows.groupBy("actor", "tactic", "technique").agg(F.bool_or(F.col("hop") == 1).alias("direct"), F.bool_or(F.col("hop") == 2).alias("via_software"))


def campaign_techniques(actors: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(actor, technique) used by campaigns attributed to the actor: kept apart from the gold ids."""
    kind = nodes.select("id", "type")
    by = edges.where("rel = 'attributed-to'").join(kind.where("type = 'campaign'").select(F.col("id").alias("src")), "src", "left_semi").join(kind.where("type = 'intrusion-set'").select(F.col("id").alias("dst")), "dst", "left_semi")
    used = gold_techniques(by.select(F.col("src").alias("actor"), F.lit(None).cast("string").alias("tactic")).distinct(), nodes, edges).where("direct")
    return actors.select("actor").distinct().join(by.select(F.col("dst").alias("actor"), F.col("src").alias("campaign")), "actor").join(used.select(F.col("actor").alias("campaign"), "technique"), "campaign").select("actor", "technique").distinct()


def edge_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src_type, rel, dst_type, n, share): most frequent first; types of missing nodes are what their ids begin with."""
    from fathom.functions.text import reference_type

    kind = nodes.select("id", "type")
    rows = edges.join(kind.select(F.col("id").alias("src"), F.col("type").alias("a")), "src", "left").join(kind.select(F.col("id").alias("dst"), F.col("type").alias("b")), "dst", "left")
    rows = rows.groupBy(F.coalesce("a", reference_type(F.col("src"))).alias("src_type"), "rel", F.coalesce("b", reference_type(F.col("dst"))).alias("dst_type")).agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n").alias("total"))
    out = rows.crossJoin(F.broadcast(total)).select("src_type", "rel", "dst_type", "n", (F.col("n") / F.col("total")).alias("share"))
    return out.orderBy(F.desc("n"), "src_type", "rel", "dst_type")


def relation_statistics(edges: DataFrame) -> DataFrame:
    """(rel, n): most frequent first."""
    return edges.groupBy(F.coalesce("rel", F.lit("<unknown>")).alias("rel")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rel")


#: The triples that tell who uses what.
TRIPLES = (
    ("intrusion-set", "uses", "attack-pattern"), ("intrusion-set", "uses", "malware"), ("intrusion-set", "uses", "tool"), ("campaign", "attributed-to", "intrusion-set"),
    ("campaign", "uses", "attack-pattern"), ("campaign", "uses", "malware"), ("campaign", "uses", "tool"),
)


def chosen_triples(statistics: DataFrame, triples: tuple = TRIPLES) -> DataFrame:
    """(position, src_type, rel, dst_type, n, percent) of some triples, 0 where there is none, and their total in a last row without types."""
    spark = statistics.sparkSession
    wanted = spark.createDataFrame([(i, *t) for i, t in enumerate(triples)], "position int, src_type string, rel string, dst_type string")
    rows = wanted.join(statistics.drop("share"), ["src_type", "rel", "dst_type"], "left").select("position", "src_type", "rel", "dst_type", F.coalesce("n", F.lit(0)).alias("n"))
    none = F.lit(None).cast("string")
    last = rows.agg(F.sum("n").alias("n")).select(F.lit(len(triples)).alias("position"), none.alias("src_type"), none.alias("rel"), none.alias("dst_type"), "n")
    total = statistics.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1)).alias("total"))
    out = rows.unionByName(last).crossJoin(F.broadcast(total))
    return out.select("position", "src_type", "rel", "dst_type", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("percent"))


def node_statistics(nodes: DataFrame) -> DataFrame:
    """(type, n, revoked, deprecated) with a totals row whose type is null."""
    flag = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return nodes.rollup("type").agg(F.count("*").alias("n"), flag(F.col("revoked")).alias("revoked"), flag(F.col("deprecated")).alias("deprecated"))


# --- actors ----------------------------------------------------------------------------------


def actor_edges(table: DataFrame, kind: str) -> DataFrame:
    """A table (name, others) of aliases or relations to edges in both directions, names normalised; of rows with one name the last (position) counts."""
    low = lambda c: F.lower(F.trim(c))
    last = table.groupBy(low(F.col("name")).alias("a")).agg(F.max_by("others", "position").alias("others"))
    one = last.select("a", F.explode("others").alias("b")).select("a", low(F.col("b")).alias("b"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().withColumn("kind", F.lit(kind))


def closure(edges: DataFrame, least: str = "component") -> DataFrame:
    """(id, component) over edges (a, b): two names of one component are connected by one or more edges."""
    names = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    label = names.withColumn(least, F.col("id"))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    written = label
    while True:  # labels go over an edge and then to their own label's label, so paths halve
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min(least).alias("n"))
        step = label.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", F.least(F.col(least), F.col("n")).alias(least), F.col(least).alias("_old"))
        jump = step.select(F.col("id").alias(least), F.col(least).alias("_up"))
        new = _table(step.join(jump, least, "left").select("id", F.least(F.col(least), F.col("_up")).alias(least), "_old"))
        if new.where(F.col(least) != F.col("_old")).isEmpty():
            _discard(written)
            return new.select("id", least)
        last, label, written = written, new.select("id", least), new
        _discard(last)


def _table(df: DataFrame) -> DataFrame:
    from fathom.sinks import materialized

    return materialized(df)


def _discard(df: DataFrame) -> None:
    from fathom.sinks import discard

    discard(df)


def actor_verdicts(pairs: DataFrame, aliases: DataFrame, related: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with verdict: C where aliases connect them, P where aliases and relations together do, else I.

    A name without an edge is not even connected with itself."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = pairs.withColumn("_a", low(F.col("a"))).withColumn("_b", low(F.col("b")))
    known = {"c": closure(aliases), "p": closure(aliases.unionByName(related))}
    for tag, label in known.items():
        for side in ("_a", "_b"):
            out = out.join(label.select(F.col("id").alias(side), F.col("component").alias(tag + side)), side, "left")
    same = lambda t: F.coalesce(F.col(f"{t}_a") == F.col(f"{t}_b"), F.lit(False))
    return out.select(*pairs.columns, F.when(same("c"), "C").when(same("p"), "P").otherwise("I").alias("verdict"))
