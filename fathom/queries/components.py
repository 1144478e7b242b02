"""Sources, renderers, gold and evaluation over the star-schema tables in the shapes that feeds and bundles have."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import render
from fathom.functions import text as T
from fathom.operators import gold, graph, metrics, sections
from fathom.operators.layout import spread
from fathom.operators.substrings import contained, mentions
from fathom.plans import bakeoff, certification, evaluation, ingest, summary
from fathom.plans import retrieval as plans
from fathom.queries import query, table
from fathom.queries.retrieval import ASKED, DENSE, HALF, _cosine, _dense
from fathom.queries.text import LINKS
from fathom.sinks import new_folder, versioned
from fathom.sources import feeds, files, stix

NL = "chr(10)"


def _key(prefix, c):
    return F.concat(F.lit(prefix), (F.col(c) if isinstance(c, str) else c).cast("string"))


def _read(rows, schema: str):
    """Rows as a source gives them: JSON text, read by the source's schema."""
    return rows.select(F.from_json(F.to_json(F.struct(*rows.columns)), schema).alias("o")).select("o.*")


def _objects(spark, d):
    """A bundle: parts as techniques, suppliers as groups, first lines of orders as edges, some revoked, some to nothing."""
    part = table(spark, d, "part").select(
        F.col("p_partkey").cast("int").alias("position"), F.lit("attack-pattern").alias("type"), _key("ap--", "p_partkey").alias("id"), F.col("p_name").alias("name"),
        F.concat(F.lit("  "), F.col("p_type"), F.lit(" \t of "), F.col("p_brand")).alias("description"),
        F.array(F.struct(F.lit("other").alias("source_name"), F.lit("x").alias("external_id")), F.struct(F.lit("mitre-attack").alias("source_name"), _key("T", "p_partkey").alias("external_id"))).alias("external_references"),
        F.array(F.struct(F.lit("mitre-attack").alias("kill_chain_name"), _key("size-", "p_size").alias("phase_name"))).alias("kill_chain_phases"), (F.col("p_partkey") % 10 == 0).alias("revoked"),
    )
    group = table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("position"), F.lit("intrusion-set").alias("type"), _key("is--", "s_suppkey").alias("id"), F.col("s_name").alias("name"))
    key = F.col("l_orderkey")
    edge = table(spark, d, "lineitem").where("l_linenumber = 1").select(
        key.cast("int").alias("position"), F.lit("relationship").alias("type"), _key("rel--", "l_orderkey").alias("id"), F.when(key % 7 == 0, "mitigates").otherwise("uses").alias("relationship_type"),
        _key("is--", "l_suppkey").alias("source_ref"), F.when(key % 13 == 0, "ap--none").otherwise(_key("ap--", "l_partkey")).alias("target_ref"),
        F.when(key % 3 == 0, F.concat(F.lit(" seen "), F.col("l_returnflag"))).alias("description"), (key % 11 == 0).alias("revoked"),
    )
    rows = part.unionByName(group, allowMissingColumns=True).unionByName(edge, allowMissingColumns=True)
    return rows.select("position", F.from_json(F.to_json(F.struct(*[c for c in rows.columns if c != "position"])), stix.OBJECT).alias("o")).select("position", "o.*")


@query(f"""SELECT substr(sha256('mitre:T' || p_partkey), 1, 16) AS id, 'T' || p_partkey AS attack_id,
  'T' || p_partkey || ': ' || p_name || {NL} || 'Tactics: size-' || p_size || {NL} || {NL} || p_type || ' of ' || p_brand AS content FROM part WHERE p_partkey % 10 <> 0""")
def stix_techniques(spark, d):
    return stix.techniques(_objects(spark, d)).select("id", "attack_id", "content")


@query(f"""SELECT substr(sha256('mitre-rel:rel--' || l_orderkey), 1, 16) AS id, 'T' || p_partkey AS attack_id,
  s_name || ' uses ' || p_name || ' (T' || p_partkey || ')' || CASE WHEN l_orderkey % 3 = 0 THEN {NL} || {NL} || 'seen ' || l_returnflag ELSE '' END AS content
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1 AND l_orderkey % 7 <> 0 AND l_orderkey % 13 <> 0 AND l_orderkey % 11 <> 0""")
def stix_relationships(spark, d):
    return stix.relationships(_objects(spark, d)).select("id", "attack_id", "content")


EDGES = """e AS (SELECT CASE WHEN l_orderkey % 7 = 0 THEN 'mitigates' ELSE 'uses' END AS rel, CASE WHEN l_orderkey % 13 = 0 THEN 'ap' ELSE 'attack-pattern' END AS dst FROM lineitem WHERE l_linenumber = 1)"""


@query(f"""WITH {EDGES}, w(position, src_type, rel, dst_type) AS (VALUES (0, 'intrusion-set', 'uses', 'attack-pattern'), (1, 'intrusion-set', 'uses', 'malware'), (2, 'intrusion-set', 'uses', 'tool'), (3, 'campaign', 'attributed-to', 'intrusion-set'),
  (4, 'campaign', 'uses', 'attack-pattern'), (5, 'campaign', 'uses', 'malware'), (6, 'campaign', 'uses', 'tool')), t AS (SELECT count(*) AS total FROM e),
c AS (SELECT w.position, w.src_type, w.rel, w.dst_type, CASE WHEN w.position = 0 THEN (SELECT count(*) FROM e WHERE rel = 'uses' AND dst = 'attack-pattern') ELSE 0 END AS n FROM w)
SELECT position, src_type, rel, dst_type, n::BIGINT AS n, round(100 * n / total, 1) AS percent FROM (SELECT * FROM c UNION ALL SELECT 7, NULL, NULL, NULL, sum(n) FROM c), t""")
def edge_triples(spark, d):
    objects = _objects(spark, d)
    return graph.chosen_triples(graph.edge_statistics(stix.nodes(objects), stix.edges(objects)))


@query(f"WITH {EDGES} SELECT rel, count(*) AS n FROM e GROUP BY rel")
def relation_totals(spark, d):
    return graph.relation_statistics(stix.edges(_objects(spark, d)))


def _campaigns(spark, d):
    """Customers as campaigns of suppliers: attributed by the nation's number, using the parts of their orders' first lines."""
    part = stix.nodes(_objects(spark, d)).select("id", "type", "external_id", "phases", "revoked", "deprecated")
    none = F.lit(None).cast(part.schema["phases"].dataType)
    campaign = table(spark, d, "customer").select(_key("c--", "c_custkey").alias("id"), F.lit("campaign").alias("type"), F.lit(None).cast("string").alias("external_id"), none.alias("phases"), F.lit(False).alias("revoked"), F.lit(False).alias("deprecated"))
    of = table(spark, d, "customer").select(_key("c--", "c_custkey").alias("src"), F.lit("attributed-to").alias("rel"), F.concat(F.lit("is--"), (F.col("c_nationkey") + 1).cast("string")).alias("dst"))
    lines = table(spark, d, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_partkey")
    used = lines.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select(_key("c--", "o_custkey").alias("src"), F.lit("uses").alias("rel"), _key("ap--", "l_partkey").alias("dst"))
    return part.unionByName(campaign), of.unionByName(used)


@query("""SELECT DISTINCT 'is--' || s_suppkey AS actor, 'T' || l_partkey AS technique FROM supplier JOIN customer ON c_nationkey + 1 = s_suppkey JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 WHERE l_partkey % 10 <> 0 AND length('T' || l_partkey) = 5""")
def campaign_paths(spark, d):
    nodes, edges = _campaigns(spark, d)
    return graph.campaign_techniques(table(spark, d, "supplier").select(_key("is--", "s_suppkey").alias("actor")), nodes, edges)


@query(f"""WITH q AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN 'precise' ELSE 'relationship_direct' END AS category FROM supplier),
u AS (SELECT DISTINCT l_suppkey AS k, 'T' || l_partkey AS t FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1 AND l_orderkey % 7 <> 0 AND l_orderkey % 13 <> 0 AND p_partkey % 10 <> 0 AND p_size = 7 AND length('T' || l_partkey) = 5),
g AS (SELECT k, count(*) AS n, list_sort(list(t)) AS ts FROM u GROUP BY k)
SELECT 'R' || q.k AS query_id, CASE WHEN category = 'precise' THEN NULL WHEN q.k % 3 = 0 THEN 'unresolved' WHEN q.k % 7 = 0 THEN 'actor_unmatched' ELSE 'resolved' END AS gold_status,
  CASE WHEN category <> 'precise' AND q.k % 3 <> 0 AND q.k % 7 <> 0 THEN coalesce(array_to_string(g.ts, ','), '') ELSE 'T1001.002' END AS gold_ids,
  CASE WHEN category <> 'precise' AND q.k % 2 = 0 THEN 'T1002' END AS before,
  CASE WHEN category <> 'precise' AND q.k % 3 <> 0 AND q.k % 7 <> 0 THEN coalesce(list_contains(g.ts, 'T1001'), false) END AS seed_survived,
  CASE WHEN category <> 'precise' AND q.k % 3 <> 0 AND q.k % 7 <> 0 THEN 'exact_name' END AS mode FROM q LEFT JOIN g ON g.k = q.k""")
def gold_rebuild(spark, d):
    key = F.col("s_suppkey")
    name = F.when(key % 7 == 0, F.lit("Nobody")).otherwise(F.col("s_name"))
    notes = F.when(key % 3 == 0, F.lit("no path")).otherwise(F.concat(F.lit("Direct: "), name, F.lit(" -> x; tactic = size-"), F.lit("seven")))
    queries = table(spark, d, "supplier").select(F.concat(F.lit("R"), key.cast("string")).alias("query_id"), F.when(key % 5 == 0, "precise").otherwise(gold.CATEGORY).alias("category"), notes.alias("notes"), F.array(F.lit("T1001.002")).alias("gold_attack_ids"))
    sample = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("R"), key.cast("string")).alias("query_id"), F.array(F.lit("T1002")).alias("gold_attack_ids"))
    objects = _objects(spark, d)
    nodes = stix.nodes(objects).withColumn("phases", F.transform("phases", lambda p: p.withField("phase_name", F.regexp_replace(p["phase_name"], "^size-7$", "size-seven"))))
    names = stix.nodes(objects).where("type = 'intrusion-set'").select("id", "name", "aliases", "position")
    out = gold.rebuild(queries, sample, nodes, stix.edges(objects), names)
    joined = lambda c: F.array_join(c, ",")
    return out.select("query_id", "gold_status", joined("gold_attack_ids").alias("gold_ids"), joined("prev_annotator_gold").alias("before"), F.col("gold_provenance.seed_survived").alias("seed_survived"), F.col("gold_provenance.actor_match_mode").alias("mode"))


# --- feeds ---------------------------------------------------------------------------------------


@query(f"""SELECT substr(sha256('otx:p' || p_partkey), 1, 16) AS id, 'p' || p_partkey AS pulse_id, p_name || {NL} || {NL} || p_type
  || CASE WHEN p_partkey % 4 = 0 THEN {NL} || {NL} || 'Attributed to ' || p_brand || '.' ELSE '' END || {NL} || {NL} || 'Associated malware: Mal' || p_size || ', plain.'
  || CASE WHEN p_partkey % 2 = 0 THEN {NL} || {NL} || 'Targeted countries: X, Y.' ELSE '' END || {NL} || {NL} || 'Key indicators: 10.0.0.' || p_size || '.' AS content FROM part""")
def pulse_documents(spark, d):
    key = F.col("p_partkey")
    rows = spread(table(spark, d, "part")).select(
        _key("p", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat(F.lit(" "), F.col("p_type"), F.lit("  ")).alias("description"), F.when(key % 4 == 0, F.col("p_brand")).otherwise("").alias("adversary"),
        F.array(F.concat(F.lit('{"id": "m", "display_name": "Mal'), F.col("p_size").cast("string"), F.lit('"}')), F.lit("plain"), F.lit("")).alias("malware_families"),
        F.when(key % 2 == 0, F.array(F.lit("X"), F.lit("Y"))).alias("targeted_countries"), F.array(F.struct(_key("10.0.0.", "p_size").alias("indicator"), F.lit("IPv4").alias("type")), F.struct(F.lit("").alias("indicator"), F.lit("x").alias("type"))).alias("indicators"),
    )
    return feeds.pulses(_read(rows, feeds.PULSE)).select("id", "pulse_id", "content")


@query("""SELECT 'd' || s_suppkey || '.example' AS domain, 'Passive DNS history for domain d' || s_suppkey || '.example.' || CASE WHEN s_suppkey % 2 = 0 THEN ' Observed from 2024-01-01 to 2024-02-01.' ELSE '' END
  || ' IP resolutions: 10.0.0.' || s_nationkey || ' (AS' || s_nationkey || ' / Net) seen a to b; 10.1.1.1. Known subdomains: w.d.' AS content FROM supplier""")
def passive_dns_documents(spark, d):
    seen = F.when(F.col("s_suppkey") % 2 == 0, F.lit("2024-01-01")).otherwise("")
    address = lambda ip, asn, name, a, b: F.struct(ip.alias("ip"), asn.alias("asn"), F.lit(name).alias("asn_name"), F.lit(a).alias("first_seen"), F.lit(b).alias("last_seen"))
    rows = table(spark, d, "supplier").select(
        F.concat(F.lit("d"), F.col("s_suppkey").cast("string"), F.lit(".example")).alias("domain"), seen.alias("first_seen"), F.lit("2024-02-01").alias("last_seen"),
        F.array(address(_key("10.0.0.", "s_nationkey"), _key("AS", "s_nationkey"), "Net", "a", "b"), address(F.lit("10.1.1.1"), F.lit(""), "", "", "")).alias("resolutions"), F.array(F.lit("w.d")).alias("subdomains"),
    )
    return feeds.passive_dns(_read(rows, feeds.PDNS)).select(F.get_json_object("metadata", "$.domain").alias("domain"), "content")


@query("""SELECT substr(sha256('vt:d' || s_suppkey), 1, 16) AS id, 'VirusTotal analysis of domain d' || s_suppkey || '. Detection: ' || s_nationkey || ' malicious, 0 suspicious, 2 harmless out of ' || (s_nationkey + 2) || ' engines.'
  || CASE WHEN s_suppkey % 2 = 0 THEN ' Matched YARA rules: r1.' ELSE '' END || ' Tags: t1, t2.' AS content, '2024-06-01T00:00:00+00:00' AS last_modified FROM supplier""")
def scan_documents(spark, d):
    rule = F.struct(F.lit("r1").alias("rule_name"))
    attributes = F.struct(
        F.create_map(F.lit("malicious"), F.col("s_nationkey"), F.lit("harmless"), F.lit(2)).alias("last_analysis_stats"), F.when(F.col("s_suppkey") % 2 == 0, F.array(rule)).alias("crowdsourced_yara_results"),
        F.array(F.lit("t1"), F.lit("t2")).alias("tags"), F.lit(1717200000).cast("long").alias("last_modification_date"),
    )
    rows = table(spark, d, "supplier").select(F.struct(_key("d", "s_suppkey").alias("id"), attributes.alias("attributes")).alias("data"))
    return feeds.scans(_read(rows, feeds.SCAN)).select("id", "content", F.get_json_object("metadata", "$.last_modified").alias("last_modified"))


@query("""SELECT lower(trim(c_name)) AS domain, 'reg' || c_nationkey AS registrar, c_nationkey::VARCHAR AS iana_id, '' AS created FROM customer WHERE c_custkey % 3 <> 0""")
def whois_lookups(spark, d):
    rows = table(spark, d, "customer").select(
        (F.col("c_custkey") % 3 != 0).cast("int").alias("status"), F.concat(F.lit(" "), F.col("c_name")).alias("domain_name"),
        F.struct(F.col("c_nationkey").cast("string").alias("iana_id"), _key("reg", "c_nationkey").alias("registrar_name")).alias("domain_registrar"),
    )
    return feeds.whois_lookups(_read(rows, feeds.WHOXY_RECORD)).select("domain", "registrar", "iana_id", "created")


@query("""SELECT 'd' || o_custkey AS domain, arg_max('r' || o_orderkey, (strftime(o_orderdate, '%Y-%m-%d'), -o_orderkey)) AS registrar FROM orders GROUP BY o_custkey""")
def whois_history(spark, d):
    """Of the snapshots of a day the first in the list counts, which is in order of the keys."""
    record = F.struct(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("query_time"), F.lit(" ").alias("domain_name"), F.struct(F.lit("").alias("iana_id"), _key("r", "o_orderkey").alias("registrar_name")).alias("domain_registrar"))
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(record)).alias("whois_records"))
    rows = rows.select(F.lit(1).alias("status"), _key("d", "o_custkey").alias("domain_name"), "whois_records")
    fields = "query_time:string,domain_name:string,create_date:string,update_date:string,expiry_date:string,domain_registrar:struct<iana_id:string,registrar_name:string>,registrant_contact:struct<full_name:string,email_address:string>,name_servers:array<string>,domain_status:array<string>"
    return feeds.whois_history(_read(rows, f"status int, domain_name string, whois_records array<struct<{fields}>>")).select("domain", "registrar")


#: Anchors put behind each page's own, with character references, quotes of both kinds and none.
PLANTED = "html || '<a class=''x'' href=''/sites/default/files/' || page_id || '&amp;v&#61;&#x31;.' || CASE WHEN page_id % 2 = 0 THEN 'PDF' ELSE 'html' END || '''>a</a> <A href=../x/y&lt;.pdf>b</A> <a data-href=\"no.pdf\">c</a>'"


@query(f"""WITH {LINKS.replace("FROM pages)", f"FROM (SELECT page_id, url, {PLANTED} AS html FROM pages))")}
SELECT page_id, link FROM links WHERE ends_with(lower(link), '.pdf') AND contains(link, '/sites/default/files/')""")
def report_links(spark, d):
    """All anchors of the pages, and some put behind them: which lead to reports that lie where reports are kept."""
    pages = table(spark, d, "pages").withColumn("html", F.expr(PLANTED))
    return files.report_links(files.links(pages, keep=("page_id",)), "files").select("page_id", "link")


@query(r"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'T1059,T1003.001' ELSE 'T1110' END AS gold FROM conversations WHERE trim(text) <> '' AND turn % 3 <> 0""")
def labelled_texts(spark, d):
    ids = F.when(F.col("turn") % 3 == 0, "none").when(F.col("turn") % 2 == 0, "T1059; T1003.001, T1059").otherwise("see T1110.")
    rows = files.labelled_texts(table(spark, d, "conversations").withColumn("ids", ids), "text", "ids")
    return rows.select("conv_id", "turn", F.array_join("gold", ",").alias("gold"))


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS position, c_name AS text, c_mktsegment AS gold FROM customer")
def paired_lines(spark, d):
    """Two columns as text files of their own, joined by the lines' numbers."""
    rows, folder = table(spark, d, "customer"), new_folder(spark, "lines")
    for name, column in (("text", "c_name"), ("gold", "c_mktsegment")):
        rows.repartitionByRange("c_custkey").sortWithinPartitions("c_custkey").select(column).write.text(f"{folder}/{name}")
    return files.paired(spark, f"{folder}/text/part-*", f"{folder}/gold/part-*")


@query("SELECT o_orderstatus AS status, count(*) AS n, coalesce(sum(o_orderkey % 5), 0)::BIGINT AS chunks FROM orders GROUP BY o_orderstatus")
def status_counts(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 5).alias("chunks"), "o_orderkey")
    return ingest.status_counts(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 2 <> 0"))


@query(r"""WITH t AS (SELECT conv_id, turn, regexp_replace(regexp_replace(replace(coalesce(text, '') || chr(10) || '17' || chr(10) || 'Page 3 of 9', chr(61607), '-'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS text FROM conversations),
l AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\r\n|\n|\r'), lambda x: NOT regexp_full_match(x, '\s*\d{1,4}\s*')) AS ls FROM t),
c AS (SELECT conv_id, turn, regexp_replace(array_to_string(ls[:-2], chr(10)), '^\s+|\s+$', '', 'g') AS text FROM l)
SELECT conv_id AS doc_id, turn AS page, md5(text) AS text FROM c WHERE length(text) >= 50""")
def page_sections(spark, d):
    """Each turn as a page, a page number and a footer behind it, as sections."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n17\nPage 3 of 9"))
    pages = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), text.alias("text"))
    return sections.page_sections(pages).select("doc_id", "page", F.md5("text").alias("text"))


@query(r"""SELECT event_id, 'APT ' || user_id AS actor, 'initial-access' AS tactic, CASE WHEN event_id % 4 = 0 THEN '' ELSE strftime(make_timestamp(event_id * 86400000000), '%Y-%m-%dT%H:%M:%S+00:00') END AS iso,
  CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN 'APT 29' WHEN 4 THEN '' ELSE 'Lazarus' END AS named, 3 AS n_words, CASE WHEN event_id % 2 = 0 THEN 'T1059.001' END AS chunk_technique FROM events""")
def scalar_texts(spark, d):
    key = F.col("event_id")
    notes = F.concat(F.lit("Direct: APT "), F.col("user_id").cast("string"), F.lit(" -> uses; tactic = initial-access"))
    said = F.element_at(F.array(*[F.lit(x) for x in ("NA", "Cannot be determined.", "\n **none** ", '"APT 29."\nmore', "N/A", "`Lazarus.`")]), (key % 6 + 1).cast("int"))
    metadata = F.when(key % 2 == 0, F.lit('{"attack_id": " t1059.001 "}')).otherwise('{"attack_id": " "}')
    return table(spark, d, "events").select(
        "event_id", T.note_actor(notes).alias("actor"), T.note_tactic(notes).alias("tactic"), T.iso_from_epoch(F.when(key % 4 != 0, key * 86400)).alias("iso"), T.actor_name(said).alias("named"),
        T.word_count(F.lit(" one two\tthree ")).alias("n_words"), T.chunk_technique(metadata).alias("chunk_technique"),
    )


# --- answers and evaluation ------------------------------------------------------------------------


def _results(spark, d, k=10):
    """The best vectors as results with content: techniques by label, pulses by parity, the source by thirds."""
    top, rows = _dense(spark, d, k)
    facts = rows.select(
        "vec_id", F.concat(F.lit("T10"), (F.col("label") + 10).cast("string")).alias("attack_id"), F.concat(F.lit("p"), (F.col("vec_id") % 7).cast("string")).alias("pulse_id"),
        F.element_at(F.array(F.lit("mitre"), F.lit("otx"), F.lit("pdf")), (F.col("vec_id") % 3 + 1).cast("int")).alias("source"), F.concat(F.lit("chunk of  APT-"), (F.col("vec_id") % 5).cast("string"), F.lit("\n end")).alias("content"),
    )
    return top.join(facts, "vec_id").select(F.col("qid").alias("query_id"), F.col("vec_id").cast("string").alias("chunk_id"), "score", "rank", "attack_id", "pulse_id", "source", "content")


RESULTS = f"""{DENSE}, res AS (SELECT qid, gold, vec_id, score, rank, 'T10' || (label + 10) AS attack_id, 'p' || (vec_id % 7) AS pulse_id, ['mitre', 'otx', 'pdf'][vec_id % 3 + 1] AS source, 'chunk of  APT-' || (vec_id % 5) AS content FROM dr WHERE rank < 10)"""


def _gold(spark, d):
    key, none = F.col("vec_id"), F.array().cast("array<string>")
    kind = F.element_at(F.array(*[F.lit(c) for c in ("precise", "otx_malware", "relationship_direct", "fuzzy")]), (F.floor(key / 100) % 4 + 1).cast("int"))
    own = F.concat(F.lit("T10"), (F.col("label") + 10).cast("string"))
    return table(spark, d, "embeddings").where(ASKED).select(
        key.alias("query_id"), kind.alias("category"), F.when(kind.isin("precise", "relationship_direct"), F.array(own)).otherwise(none).alias("gold_attack_ids"),
        F.when(kind == "otx_malware", F.array(F.lit("p1"), F.lit("p2"))).otherwise(none).alias("gold_pulse_ids"), F.when(kind == "fuzzy", F.array(F.lit("otx"))).otherwise(none).alias("gold_sources"),
        F.when(kind == "relationship_direct", F.concat(F.lit("apt-"), (F.floor(key / 100) % 5).cast("string"))).alias("gold_actor"), F.lit(None).cast("string").alias("gold_malware"),
        F.when(kind == "precise", F.array(key.cast("string"))).otherwise(none).alias("expected_chunk_ids"),
    )


GOLD = f"""{RESULTS}, gq AS (SELECT vec_id AS qid, ['precise', 'otx_malware', 'relationship_direct', 'fuzzy'][(vec_id // 100) % 4 + 1] AS category, 'T10' || (label + 10) AS own FROM embeddings WHERE {ASKED}),
mt AS (SELECT r.*, g.category, g.own, CASE g.category WHEN 'precise' THEN r.attack_id = g.own WHEN 'otx_malware' THEN r.pulse_id IN ('p1', 'p2') WHEN 'fuzzy' THEN r.source = 'otx'
  ELSE r.attack_id = g.own AND contains(lower(r.content), 'apt-' || ((r.qid // 100) % 5)) END AS hit FROM res r JOIN gq g USING (qid)),
ks(k) AS (VALUES (1), (5), (10))"""


@query(f"""WITH {GOLD}, pq AS (SELECT qid, category, k, max((hit AND rank < k)::INT) AS hit, coalesce(1.0 / (min(CASE WHEN hit THEN rank END) + 1), 0) AS rr FROM mt, ks GROUP BY ALL)
SELECT coalesce(category, 'overall') AS category, k, count(*) AS n_queries, round(avg(hit), 6) AS hit_rate, round(avg(rr), 6) AS mrr FROM pq GROUP BY GROUPING SETS ((category, k), (k))""")
def attribution_ranking(spark, d):
    ranking, _, _ = evaluation.attribution(_results(spark, d), _gold(spark, d))
    return ranking.select("category", "k", "n_queries", F.round("hit_rate", 6).alias("hit_rate"), F.round("mrr", 6).alias("mrr"))


@query(f"""WITH {GOLD}, p AS (SELECT qid, category, own, k, list_distinct(list(attack_id)) AS l FROM mt, ks WHERE rank < k AND category IN ('precise', 'relationship_direct') GROUP BY ALL)
SELECT category, k, sum(list_contains(l, own)::INT)::BIGINT AS tp, sum(len(l) - list_contains(l, own)::INT)::BIGINT AS fp, sum(1 - list_contains(l, own)::INT)::BIGINT AS fn FROM p GROUP BY ALL""")
def attribution_sets(spark, d):
    _, sets, _ = evaluation.attribution(_results(spark, d), _gold(spark, d))
    return sets.select("category", "k", "tp", "fp", "fn")


@query(f"""WITH {GOLD}, p AS (SELECT qid, k, list_distinct(list(pulse_id)) AS l FROM mt, ks WHERE rank < k AND category = 'otx_malware' GROUP BY ALL)
SELECT 'otx_malware' AS category, k, round(sum(list_contains(l, 'p1')::INT + list_contains(l, 'p2')::INT) / (2 * count(*)), 6) AS recall FROM p GROUP BY k""")
def pulse_recall(spark, d):
    _, _, recall = evaluation.attribution(_results(spark, d), _gold(spark, d))
    return recall.select("category", "k", F.round("recall", 6).alias("recall"))


@query(f"""WITH {GOLD}, m2 AS (SELECT qid, category, rank, CASE category WHEN 'precise' THEN vec_id = qid WHEN 'otx_malware' THEN false WHEN 'fuzzy' THEN source = 'otx' ELSE attack_id = own END AS hit FROM mt),
pq AS (SELECT qid, category, k, max((hit AND rank < k)::INT) AS hit, coalesce(1.0 / (min(CASE WHEN hit THEN rank END) + 1), 0) AS rr FROM m2, ks GROUP BY ALL)
SELECT coalesce(category, 'overall') AS category, k, round(avg(hit), 6) AS hit_rate, round(avg(rr), 6) AS mrr FROM pq GROUP BY GROUPING SETS ((category, k), (k))""")
def query_set_metrics(spark, d):
    out = evaluation.query_set(_results(spark, d), _gold(spark, d))
    return out.select("category", "k", F.round("hit_rate", 6).alias("hit_rate"), F.round("mrr", 6).alias("mrr"))


@query(f"""WITH {GOLD}, pq AS (SELECT qid, category, max(hit::INT) AS hit, coalesce(1.0 / (min(CASE WHEN hit THEN rank END) + 1), 0) AS rr, string_agg(vec_id::VARCHAR, ',' ORDER BY rank) AS retrieved FROM mt GROUP BY ALL)
SELECT qid AS query_id, category, hit, CASE WHEN rr > 0 THEN round(1 / rr)::INT END AS target_rank, retrieved FROM pq""")
def query_records(spark, d):
    results, queries = _results(spark, d), _gold(spark, d)
    facts = ("category", "attack_id", "pulse_id", "source", "content", "gold_attack_ids", "gold_pulse_ids", "gold_sources", "gold_actor", "gold_malware")
    rows = results.join(queries, "query_id").withColumn("match", metrics.attribution_match(*[F.col(c) for c in facts]))
    out = render.query_records(metrics.per_query(rows, queries, [10]), results)
    return out.select("query_id", "category", F.element_at("hits", F.lit(10)).alias("hit"), "target_rank", F.array_join("retrieved", ",").alias("retrieved"))


@query(f"""WITH {RESULTS} SELECT qid AS query_id, string_agg('[' || (rank + 1) || '] attack_id=' || attack_id || ' | source=' || source || ' | ' || replace(content, '  ', ' ') || ' end', chr(10) ORDER BY rank) AS candidates FROM res WHERE rank < 3 GROUP BY qid""")
def candidate_lines(spark, d):
    return render.candidate_lines(_results(spark, d), 3)


@query(f"""WITH {RESULTS} SELECT qid AS query_id, 'system' AS first_role, 'rules' AS rules, 'user' AS second_role, 'q' || qid AS asked, max(CASE WHEN rank = 0 THEN vec_id::VARCHAR END) AS best FROM res GROUP BY qid""")
def context_messages(spark, d):
    asked = _gold(spark, d).select("query_id", F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("text"))
    m = render.context_messages(asked, _results(spark, d).withColumn("rank", F.col("rank").cast("int")), "rules").withColumn("u", F.col("messages")[1]["content"])
    return m.select(
        "query_id", F.col("messages")[0]["role"].alias("first_role"), F.col("messages")[0]["content"].alias("rules"), F.col("messages")[1]["role"].alias("second_role"),
        F.get_json_object("u", "$.query").alias("asked"), F.get_json_object("u", "$.context[0].chunk_id").alias("best"),
    )


@query(f"""WITH {RESULTS} SELECT DISTINCT qid AS query_id, CASE qid // 100 % 3 WHEN 0 THEN 'T1059,T1003.001' WHEN 1 THEN '' ELSE 'T1001' END AS techniques, CASE qid // 100 % 3 WHEN 0 THEN 'APT X' ELSE '' END AS actor FROM res""")
def annotated_answers(spark, d):
    """Techniques and actors out of a model's answers; one that gives none names nothing."""
    asked = _gold(spark, d).select("query_id", F.concat(F.lit("q"), F.floor(F.col("query_id") / 100).cast("string")).alias("text"))
    turn = lambda p: F.regexp_extract(p, "q([0-9]+)$", 1).cast("int") % 3
    results = _results(spark, d)
    ids = plans.annotate(asked, results, lambda p: F.when(turn(p) == 0, "T1059 and T1003.001, T1059").when(turn(p) == 2, "T1001."), "list")
    who = plans.attribute(asked, results, lambda p: F.when(turn(p) == 0, '"APT X."').when(turn(p) == 2, "Undetermined."), "name")
    return ids.join(who, "query_id").select("query_id", F.array_join("techniques", ",").alias("techniques"), "actor")


@query("SELECT count(*) FILTER (o_orderkey % 3 = 0) AS C, count(*) FILTER (o_orderkey % 3 = 1) AS P, count(*) FILTER (o_orderkey % 3 = 2) AS I, count(*) AS n, round(avg((o_orderkey % 3 = 0)::INT), 6) AS correct, round(avg((o_orderkey % 3 < 2)::INT), 6) AS plausible FROM orders")
def verdict_shares(spark, d):
    rows = table(spark, d, "orders").select(F.element_at(F.array(F.lit("C"), F.lit("P"), F.lit("I")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("verdict"))
    return metrics.verdict_shares(rows).select("C", "P", "I", "n", F.round("correct", 6).alias("correct"), F.round("plausible", 6).alias("plausible"))


@query(f"""WITH {DENSE}, {_cosine("part", f"embedding[1:{HALF}]")}, pr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) - 1 AS rank FROM part),
b AS (SELECT 'half' AS name, qid, vec_id, rank FROM pr UNION ALL SELECT 'whole', qid, vec_id, rank FROM dr), g AS (SELECT vec_id AS qid, vec_id + 1 AS gold FROM embeddings WHERE {ASKED}), n AS (SELECT DISTINCT name FROM b)
SELECT n.name, round(avg((rank IS NOT NULL)::INT), 6) AS recall_at_k, round(avg(coalesce(1 / (rank + 1), 0)), 6) AS mrr FROM n CROSS JOIN g LEFT JOIN b ON b.name = n.name AND b.qid = g.qid AND b.vec_id = g.gold AND b.rank < 100 GROUP BY n.name""")
def model_bakeoff(spark, d):
    gold_rows = table(spark, d, "embeddings").where(ASKED).select(F.col("vec_id").alias("query_id"), (F.col("vec_id") + 1).alias("gold"))
    one = lambda name, dims: bakeoff.evaluate(_dense(spark, d, 100, dims=dims)[0].withColumnsRenamed({"qid": "query_id", "vec_id": "chunk_id"}), gold_rows, 100).withColumn("name", F.lit(name))
    both = one("whole", None).unionByName(one("half", HALF))
    return bakeoff.best_first(both).select("name", F.round("recall_at_k", 6).alias("recall_at_k"), F.round("mrr", 6).alias("mrr"))


@query("""SELECT substr(sha256('d' || doc_id || ':0'), 1, 16) AS id, 'new ' || substr(text, 1, 10) AS head FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT substr(sha256('d' || doc_id || ':0'), 1, 16), substr(text, 1, 10) FROM documents WHERE doc_id % 3 <> 0""")
def upsert_changed(spark, d):
    """Chunks loaded into a versioned table, then some of them with changed content, twice: the last one counts."""
    rows = table(spark, d, "documents").select(T.chunk_id(_key("d", "doc_id"), F.lit(0)).alias("id"), F.substring("text", 1, 10).alias("head"), "doc_id")
    changed = rows.where("doc_id % 3 = 0").drop("doc_id")
    new = changed.withColumns({"head": F.lit("stale"), "seq": F.lit(1)}).unionByName(changed.withColumns({"head": F.concat(F.lit("new "), "head"), "seq": F.lit(2)}))
    path = new_folder(spark, "versioned")
    versioned.upsert(rows.drop("doc_id"), path, ["id"], buckets=8)
    versioned.upsert(new, path, ["id"])
    return versioned.read(spark, path)


@query("""SELECT n.needle, e.text FROM (SELECT DISTINCT lower(substr(city, 1, 4)) AS needle FROM clients UNION SELECT DISTINCT substr(name, 1, 2) FROM vendors) n
JOIN (SELECT DISTINCT lower(email) AS text FROM clients) e ON n.needle <> '' AND contains(e.text, n.needle)""")
def substring_pairs(spark, d):
    """Which addresses hold the beginnings of cities and vendors' names, looked up by their rarest gram."""
    clients, vendors = table(spark, d, "clients"), table(spark, d, "vendors")
    needles = clients.select(F.lower(F.substring("city", 1, 4)).alias("needle")).union(vendors.select(F.substring("name", 1, 2)))
    return contained(needles, clients.select(F.lower("email").alias("text")))


@query("""SELECT doc_id, c.id FROM documents d JOIN (SELECT DISTINCT lower(trim(city)) AS name, nation_id AS id FROM clients WHERE trim(city) <> '') c ON contains(lower(d.text), c.name) GROUP BY ALL""")
def city_mentions(spark, d):
    """The nations whose clients' cities a document names anywhere, all found in one reading of it."""
    return mentions(table(spark, d, "documents"), table(spark, d, "clients"), "doc_id", "text", "nation_id", "city")


@query("""WITH n AS (SELECT client_id AS id, lower(trim(name)) AS name, lower(trim(email)) AS alias FROM clients),
q AS (SELECT DISTINCT q AS query, lower(trim(coalesce(q, ''))) AS key FROM (SELECT upper(name) AS q FROM clients UNION ALL SELECT substr(email, 1, 9) FROM clients UNION ALL SELECT email FROM clients WHERE client_id % 3 = 0)),
a AS (SELECT query, min(id) AS id FROM q JOIN n ON key = name GROUP BY query), b AS (SELECT query, min(id) AS id FROM q JOIN n ON key = alias GROUP BY query),
p AS (SELECT query, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS id, CASE WHEN count(DISTINCT id) = 1 THEN 'alias_contains' ELSE 'alias_ambiguous' END AS mode FROM q JOIN n ON key <> '' AND contains(alias, key) GROUP BY query)
SELECT q.query, CASE WHEN a.query IS NOT NULL THEN a.id WHEN b.query IS NOT NULL THEN b.id ELSE p.id END AS id,
  CASE WHEN a.query IS NOT NULL THEN 'exact_name' WHEN b.query IS NOT NULL THEN 'exact_alias' ELSE coalesce(p.mode, 'no_match') END AS mode FROM q LEFT JOIN a USING (query) LEFT JOIN b USING (query) LEFT JOIN p USING (query)
WHERE q.query IS NOT NULL""")
def clients_matched(spark, d):
    """Names, addresses and parts of addresses, looked up among all clients."""
    rows = table(spark, d, "clients").select(F.col("client_id").alias("id"), "name", F.array("email").alias("aliases"), F.col("client_id").alias("position"), "email")
    asked = rows.select(F.upper("name").alias("query")).union(rows.select(F.substring("email", 1, 9))).union(rows.where("id % 3 = 0").select("email"))
    return graph.match_names(asked.where("query IS NOT NULL"), rows)


@query("""WITH s AS (SELECT sale_id, coalesce(sold_at, TIMESTAMP '2000-01-01') AS t, total, coalesce(priority, 0) > 3 AS pass, sale_id % 4 AS m FROM sales WHERE sale_id IS NOT NULL),
r AS (SELECT 'technique_extraction' AS capability, t, sale_id, total AS score, pass AS first FROM s WHERE m < 2 AND total IS NOT NULL
  UNION ALL SELECT 'actor_attribution', t, sale_id, total / 2, FALSE FROM s WHERE m = 1 AND total IS NOT NULL UNION ALL SELECT 'generation_grounding', t, sale_id, total, FALSE FROM s WHERE m = 2)
SELECT n.capability, CASE WHEN b.capability IS NOT NULL THEN 'AVAILABLE' WHEN n.capability = 'generation_grounding' THEN 'NOT RUN' ELSE 'NOT AVAILABLE' END AS status, b.r.path AS path, round(b.r.score, 4) AS score
FROM (SELECT unnest(['technique_extraction', 'actor_attribution', 'heterogeneous_retrieval', 'generation_grounding']) AS capability) n
LEFT JOIN (SELECT capability, max(struct_pack(first := first, t := t, path := sale_id::VARCHAR, score := score)) AS r FROM r GROUP BY capability) b USING (capability)""")
def capability_summary(spark, d):
    """Each sale as a saved result: certificates of one capability or both, answers, and attributions without any result."""
    rows = table(spark, d, "sales").where("sale_id IS NOT NULL")
    m, total = F.col("sale_id") % 4, F.col("total")
    own = F.struct(F.struct(total.alias("micro_f1"), (F.coalesce("priority", F.lit(0)) > 3).alias("pass")).alias("enterprise"))
    value = F.when(m < 2, F.to_json(F.struct(own.alias("technique"), F.when(m == 1, F.struct((total / 2).alias("plausible_acc"))).alias("actor")))).when(m == 2, F.to_json(F.struct(total.alias("faithfulness"), F.lit(1).alias("n")))).otherwise('{"results": []}')
    kind = F.when(m < 2, "certificate").when(m == 2, "answers").otherwise("attribution")
    time = F.coalesce("sold_at", F.lit("2000-01-01").cast("timestamp_ntz")).cast("timestamp")
    saved = rows.select(kind.alias("kind"), F.col("sale_id").cast("string").alias("path"), time.alias("time"), value.alias("value"))
    score = F.coalesce(*[F.element_at("measures", k) for k in ("micro_f1", "plausible_acc", "faithfulness")])
    return summary.capabilities(saved).select("capability", "status", "path", F.round(score.cast("double"), 4).alias("score"))


@query("""WITH r AS (SELECT CASE WHEN priority > 2 THEN 'enterprise' ELSE 'mobile' END AS platform, ['T' || (1000 + client_id % 50), 'T' || (1000 + sale_id % 7)] AS g,
  ['T' || (1000 + client_id % 50 + (CASE WHEN sale_id % 3 = 0 THEN 1 ELSE 0 END)), 'T' || (1000 + sale_id % 7)] AS p FROM sales WHERE client_id IS NOT NULL AND sale_id IS NOT NULL),
c AS (SELECT platform, len(list_distinct(list_intersect(g, p))) AS tp, len(list_distinct(p)) - len(list_distinct(list_intersect(g, p))) AS fp, len(list_distinct(g)) - len(list_distinct(list_intersect(g, p))) AS fn FROM r),
s AS (SELECT platform, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, count(*) AS n FROM c GROUP BY platform)
SELECT platform, platform = 'enterprise' AS gated, n, tp, fp, fn, round(2 * tp / (2 * tp + fp + fn), 6) AS micro_f1, CASE WHEN platform = 'enterprise' THEN 2 * tp / (2 * tp + fp + fn) >= 0.65 END AS pass FROM s""")
def certified_platforms(spark, d):
    """Each sale as an answer: two ids of gold and two predicted ones, by a platform with a gate and one without."""
    rows = table(spark, d, "sales").where("client_id IS NOT NULL AND sale_id IS NOT NULL")
    two = lambda shift: F.array(_key("T", F.col("client_id") % 50 + 1000 + shift), _key("T", F.col("sale_id") % 7 + 1000))
    wrong = F.when(F.col("sale_id") % 3 == 0, 1).otherwise(0)
    rows = rows.select(F.when(F.col("priority") > 2, "Enterprise ").otherwise("mobile").alias("platform"), two(0).alias("gold"), two(wrong).alias("predicted"))
    found = certification.technique_measures(certification.records(rows))
    return found.select("platform", "gated", F.col("n").cast("long").alias("n"), "tp", "fp", "fn", F.round("micro_f1", 6).alias("micro_f1"), "pass")
