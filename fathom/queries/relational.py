"""Keyed, graph, set and window operators over the star-schema tables and ``events``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.operators import graph as G
from fathom.operators import metrics as M
from fathom.operators.keyed import first_by_key, last_by_key, pending, upsert
from fathom.queries import query, table
from fathom.streaming import since


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def upsert_latest(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return last_by_key(rows, ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type", "ts")


@query("""WITH n AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_id % 2 = 1 GROUP BY user_id), o AS (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id)
SELECT user_id, coalesce(n.event_id, o.event_id) AS event_id FROM o LEFT JOIN n USING (user_id)""")
def keyed_upsert(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id")
    old = first_by_key(rows, ["user_id"], "event_id")
    return upsert(old, rows.where("event_id % 2 = 1").withColumn("seq", F.col("event_id")), ["user_id"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def pending_antijoin(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"))
    return pending(orders, done, "k").withColumnRenamed("k", "o_orderkey")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_orderstatus")
def semi_join_edges(spark, d):
    good = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(good, "o_custkey", "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("""SELECT (SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25) AS resolved, (SELECT count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 25)) AS dangling""")
def dangling_edges(spark, d):
    part = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    rows = table(spark, d, "lineitem").select("l_partkey").join(part.withColumn("hit", F.lit(True)), "l_partkey", "left")
    return rows.agg(F.count_if("hit").alias("resolved"), F.count_if(F.col("hit").isNull()).alias("dangling"))


def _bundle(spark, d):
    """Customers as groups, suppliers as software, parts as techniques: who uses what through the orders' lines."""
    customer = table(spark, d, "customer")
    none, off = F.lit(None).cast("array<struct<kill_chain_name:string,phase_name:string>>"), F.lit(False)
    part = table(spark, d, "part")
    phase = F.array(F.struct(F.lit("c").alias("kill_chain_name"), F.concat(F.lit("t"), (F.col("p_partkey") % 3).cast("string")).alias("phase_name")))
    nodes = (
        customer.select(F.concat(F.lit("g--"), F.col("c_custkey").cast("string")).alias("id"), F.lit("intrusion-set").alias("type"), F.lit(None).cast("string").alias("external_id"), none.alias("phases"), off.alias("revoked"), off.alias("deprecated"))
        .unionByName(table(spark, d, "supplier").select(F.concat(F.lit("s--"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("malware").alias("type"), F.lit(None).cast("string").alias("external_id"), none.alias("phases"), off.alias("revoked"), off.alias("deprecated")))
        .unionByName(part.select(F.concat(F.lit("p--"), F.col("p_partkey").cast("string")).alias("id"), F.lit("attack-pattern").alias("type"), F.concat(F.lit("T"), (F.col("p_partkey") % 90 + 1000).cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".001").otherwise("")).alias("external_id"), phase.alias("phases"), (F.col("p_partkey") % 10 == 0).alias("revoked"), off.alias("deprecated")))
    )
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    used = lines.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = (
        used.where("l_linenumber = 1").select(key("g--", "o_custkey").alias("src"), F.lit("uses").alias("rel"), key("p--", "l_partkey").alias("dst"))
        .unionByName(used.where("l_linenumber = 2").select(key("g--", "o_custkey").alias("src"), F.lit("uses").alias("rel"), key("s--", "l_suppkey").alias("dst")))
        .unionByName(lines.where("l_linenumber = 3").select(key("s--", "l_suppkey").alias("src"), F.lit("uses").alias("rel"), key("p--", "l_partkey").alias("dst")))
    )
    return nodes, edges, customer


GRAPH = """
t AS (SELECT p_partkey AS p, 'T' || (p_partkey % 90 + 1000) AS technique FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 3 = 1),
u AS (SELECT DISTINCT o_custkey AS c, l_partkey, l_suppkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
hop1 AS (SELECT c, technique FROM u JOIN t ON l_partkey = p WHERE l_linenumber = 1),
hop2 AS (SELECT c, technique FROM (SELECT DISTINCT c, l_suppkey AS s FROM u WHERE l_linenumber = 2) JOIN (SELECT DISTINCT l_suppkey AS s, l_partkey FROM u WHERE l_linenumber = 3) USING (s) JOIN t ON l_partkey = p)"""


@query(f"""WITH {GRAPH}, a AS (SELECT c, technique, true AS direct FROM hop1 UNION ALL SELECT c, technique, false FROM hop2)
SELECT 'g--' || c AS actor, 't1' AS tactic, technique, bool_or(direct) AS direct, bool_or(NOT direct) AS via_software FROM a GROUP BY ALL""")
def two_hop_traversal(spark, d):
    nodes, edges, customer = _bundle(spark, d)
    actors = customer.select(F.concat(F.lit("g--"), F.col("c_custkey").cast("string")).alias("actor"), F.lit("t1").alias("tactic"))
    return G.gold_techniques(actors, nodes, edges)


@query("""WITH q(query) AS (VALUES ('Supplier#000000001'), (' supplier#000000002 '), ('alias-3'), ('ias-44'), ('alias-5'), ('nothing'), ('')),
n AS (SELECT s_suppkey AS id, lower(s_name) AS name, 'alias-' || s_suppkey AS alias FROM supplier),
k AS (SELECT query, lower(trim(query)) AS key FROM q),
e AS (SELECT query, min(id) AS id FROM k JOIN n ON key = name GROUP BY query),
a AS (SELECT query, min(id) AS id FROM k JOIN n ON key = alias GROUP BY query),
p AS (SELECT query, min(id) AS id, count(DISTINCT id) AS hits FROM k JOIN n ON contains(alias, key) WHERE key <> '' GROUP BY query)
SELECT query, coalesce(e.id, a.id, CASE WHEN hits = 1 THEN p.id END) AS id,
  CASE WHEN e.id IS NOT NULL THEN 'exact_name' WHEN a.id IS NOT NULL THEN 'exact_alias' WHEN hits = 1 THEN 'alias_contains' WHEN hits > 1 THEN 'alias_ambiguous' ELSE 'no_match' END AS mode
FROM k LEFT JOIN e USING (query) LEFT JOIN a USING (query) LEFT JOIN p USING (query)""")
def prioritised_match(spark, d):
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("alias-"), F.col("s_suppkey").cast("string"))).alias("aliases"), F.col("s_suppkey").alias("position"))
    asked = spark.createDataFrame([(x,) for x in ("Supplier#000000001", " supplier#000000002 ", "alias-3", "ias-44", "alias-5", "nothing", "")], "query string")
    return G.match_names(asked, names)


VERDICTS = """WITH RECURSIVE al AS (SELECT n_name AS a, lag(n_name) OVER (PARTITION BY n_regionkey, n_nationkey % 2 ORDER BY n_nationkey) AS b FROM nation),
re AS (SELECT n_name AS a, lag(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation),
ea AS (SELECT a, b FROM al WHERE b IS NOT NULL UNION SELECT b, a FROM al WHERE b IS NOT NULL),
er AS (SELECT * FROM ea UNION SELECT a, b FROM re WHERE b IS NOT NULL UNION SELECT b, a FROM re WHERE b IS NOT NULL),
ca(a, b) AS (SELECT a, b FROM ea UNION SELECT ca.a, ea.b FROM ca JOIN ea ON ca.b = ea.a),
cr(a, b) AS (SELECT a, b FROM er UNION SELECT cr.a, er.b FROM cr JOIN er ON cr.b = er.a)
SELECT x.n_name AS a, y.n_name AS b, CASE WHEN EXISTS (SELECT 1 FROM ca WHERE a = x.n_name AND b = y.n_name) THEN 'C' WHEN EXISTS (SELECT 1 FROM cr WHERE a = x.n_name AND b = y.n_name) THEN 'P' ELSE 'I' END AS verdict FROM nation x, nation y"""


@query(VERDICTS)
def actor_components(spark, d):
    """One region and parity is C, one region alone P, two regions I."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name")
    before = lambda *by: F.lag("n_name").over(Window.partitionBy(*by).orderBy("n_nationkey"))
    shape = lambda df, kind: G.actor_edges(df.where("b IS NOT NULL").select(F.col("n_name").alias("name"), F.array("b").alias("others"), F.col("n_nationkey").alias("position")), kind)
    aliases = shape(nation.withColumn("b", before("n_regionkey", F.col("n_nationkey") % 2)), "alias")
    related = shape(nation.withColumn("b", before("n_regionkey")), "related")
    names = nation.select(F.col("n_name").alias("a"))
    return G.actor_verdicts(names.crossJoin(F.broadcast(names.withColumnRenamed("a", "b"))), aliases, related)


@query("SELECT l_returnflag AS src_type, l_linestatus AS rel, l_linenumber::VARCHAR AS dst_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lineitem GROUP BY ALL")
def edge_stats(spark, d):
    edges = table(spark, d, "lineitem").select(F.concat("l_returnflag", F.lit("--x")).alias("src"), F.col("l_linestatus").alias("rel"), F.concat(F.col("l_linenumber").cast("string"), F.lit("--y")).alias("dst"))
    nodes = spark.createDataFrame([], "id string, type string")
    return G.edge_statistics(nodes, edges).withColumn("share", F.round("share", 6))


@query("SELECT o_orderstatus AS type, count(*) AS n, count(*) FILTER (o_totalprice > 200000) AS revoked, count(*) FILTER (o_totalprice < 1000) AS deprecated FROM orders GROUP BY ROLLUP (o_orderstatus)")
def edge_stats_rollup(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("type"), (F.col("o_totalprice") > 200000).alias("revoked"), (F.col("o_totalprice") < 1000).alias("deprecated"))
    return G.node_statistics(rows)


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) ORDER BY n, lang, doc_id LIMIT 50")
def stratified_sample(spark, d):
    return M.round_robin(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 50)


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, -o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey")
def latest_snapshot(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (-F.col("o_orderkey")).alias("tie"))
    return last_by_key(rows, ["o_custkey"], "o_orderdate", "tie").drop("tie")


@query("SELECT event_type, count(*) AS n, min(event_id) AS first FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00' GROUP BY event_type")
def incremental_since(spark, d):
    rows = since(table(spark, d, "events"), "ts", F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00")))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)")
def grouping_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS recent,
  lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS quarter FROM orders""")
def window_frames(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("recent"), F.lag("o_orderkey").over(w).alias("before"), F.ntile(4).over(w).alias("quarter"))


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)")
def setops(spark, d):
    c, s, n = (table(spark, d, t).select(F.col(k).alias("k")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey")))
    return c.intersect(s).unionAll(n.subtract(s))


@query("""SELECT e.event_id, max(p.event_id) AS before FROM events e LEFT JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p ON p.user_id = e.user_id AND p.event_id = (
  SELECT arg_max(x.event_id, (x.ts, x.event_id)) FROM events x WHERE x.event_type = 'purchase' AND x.user_id = e.user_id AND (x.ts, x.event_id) <= (e.ts, e.event_id)) WHERE e.event_type = 'view' GROUP BY e.event_id""")
def asof_latest(spark, d):
    """Each view with the user's latest purchase up to then: one ordered pass a user, no range join."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = table(spark, d, "events").where(F.col("event_type").isin("view", "purchase"))
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), True).over(w)
    return rows.select("event_id", "event_type", last.alias("before")).where("event_type = 'view'").drop("event_type")


@query("SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events WHERE props IS NOT NULL) GROUP BY key")
def explode_props_json(spark, d):
    return table(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
