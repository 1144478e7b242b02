"""Cleaning, chunking, sections, tokens, ids and rendering over ``documents``, ``pages`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.functions.tokens import PORTABLE, indicators, tokenized
from fathom.operators import chunking
from fathom.operators.layout import spread
from fathom.operators.sections import BOILERPLATE, keep, merge_forward
from fathom.queries import query, table
from fathom.sources import feeds, files

CLEAN = r"regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
IOC = PORTABLE.removeprefix("(?i)")
TOKENS = rf"""
tok AS (
  SELECT doc_id, list_concat(
    list_transform(regexp_extract_all(text, '{IOC}', 0, 'i'), lambda x: lower(x)),
    list_transform(list_filter(regexp_split_to_array(regexp_replace(text, '{IOC}', ' ', 'gi'), '[^\p{{L}}\p{{N}}_]+'), lambda x: length(x) BETWEEN 2 AND 64), lambda x: lower(x))) AS t
  FROM documents)"""


@query(f"SELECT doc_id, {CLEAN} AS content FROM documents WHERE {CLEAN} <> ''")
def clean_documents(spark, d):
    """A text is cleaned once: the blank ones go by what is left of them, not by a filter that would clean them first."""
    made = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.filter(F.array(T.clean(F.col("text"))), lambda x: x.isNotNull()).alias("c"))
    return made.select("doc_id", F.explode("c").alias("content"))


@query("""
WITH s AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'whois' WHEN 1 THEN 'pdns' WHEN 2 THEN 'virustotal' WHEN 3 THEN 'otx' ELSE 'mitre' END AS tag FROM documents)
SELECT tag, CASE WHEN tag IN ('whois', 'pdns', 'virustotal') THEN 'structured' ELSE 'semantic' END AS strategy, count(*) AS n FROM s GROUP BY ALL""")
def strategy_routing(spark, d):
    tag = F.element_at(F.array(*[F.lit(x) for x in ("whois", "pdns", "virustotal", "otx", "mitre")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, d, "documents").select(tag.alias("tag")).groupBy("tag", T.chunk_strategy(F.col("tag")).alias("strategy")).agg(F.count("*").alias("n"))


@query(f"""
WITH i AS (SELECT doc_id, substr(sha256('otx:' || doc_id), 1, 16) AS document FROM documents),
c AS (SELECT *, substr(sha256(document || ':0'), 1, 16) AS chunk FROM i),
h AS (SELECT *, sha1(unhex('{T.POINT_NAMESPACE}') || encode(chunk)) AS h FROM c)
SELECT doc_id, document, chunk, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')
  || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point FROM h""")
def chunk_ids(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.document_id("otx", F.col("doc_id")).alias("document"))
    rows = rows.withColumn("chunk", T.chunk_id(F.col("document"), F.lit(0)))
    return rows.withColumn("point", T.point_id(F.col("chunk")))


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.col("text").alias("content"))


@query(f"""
WITH c AS (SELECT doc_id, {CLEAN} AS t FROM documents),
s AS (SELECT doc_id, t, unnest(range(0, greatest(length(t), 1), 2080)) AS start FROM c WHERE t <> '')
SELECT doc_id, (start // 2080)::INT AS chunk_index, substr(t, (start + 1)::INT, 2400) AS content FROM s""")
def chunk_fixed(spark, d):
    return chunking.chunk(_docs(spark, d), "fixed").select(F.col("parent_doc_id").alias("doc_id"), "chunk_index", "content")


SEMANTIC = rf"""
WITH RECURSIVE c AS (SELECT doc_id, {CLEAN} AS t FROM documents),
l AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM c WHERE t <> ''),
p AS (SELECT doc_id, ss, list_transform(range(0, len(ss) + 1), lambda i: coalesce(list_sum(list_transform(ss[1:i], lambda x: length(x))), 0)) AS pre FROM l),
r AS (
  SELECT doc_id, 0 AS j, 1 AS s, 1 AS f, len(ss) AS n, pre, ss FROM p
  UNION ALL
  SELECT doc_id, j + 1, coalesce(list_min(list_filter(range(s, e + 1), lambda q: pre[e + 1] - pre[q] <= 320)), e + 1)::INT, (e + 1)::INT, n, pre, ss
  FROM (SELECT *, greatest(f, coalesce(list_max(list_filter(range(f, n + 1), lambda q: pre[q + 1] - pre[s] <= 2400)), f)) AS e FROM r) WHERE e < n),
x AS (SELECT doc_id, j, s, ss, greatest(f, coalesce(list_max(list_filter(range(f, n + 1), lambda q: pre[q + 1] - pre[s] <= 2400)), f)) AS e FROM r)
SELECT doc_id, j::INT AS chunk_index, array_to_string(ss[s:e], ' ') AS content FROM x"""


@query(SEMANTIC)
def chunk_semantic(spark, d):
    return chunking.chunk(_docs(spark, d), "semantic").select(F.col("parent_doc_id").alias("doc_id"), "chunk_index", "content")


@query("""
SELECT lang, count(*) AS n, round(quantile_cont(length(text), 0.5), 4) AS p50, round(quantile_cont(length(text), 0.9), 4) AS p90,
  round(quantile_cont(length(text), 0.99), 4) AS p99, max(length(text)) AS longest, round(avg((length(text) > 2048)::INT), 6) AS share_long FROM documents GROUP BY lang""")
def chunk_stats(spark, d):
    size = F.length("text")
    part = lambda p: F.round(F.percentile(size, F.lit(p)), 4)
    return table(spark, d, "documents").groupBy("lang").agg(
        F.count("*").alias("n"), part(0.5).alias("p50"), part(0.9).alias("p90"), part(0.99).alias("p99"), F.max(size).cast("long").alias("longest"), F.round(F.avg((size > 2048).cast("int")), 6).alias("share_long")
    )


LINES = "SELECT doc_id, (unnest(range(1, len(ls) + 1)))::INT AS position, unnest(ls) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"
KEPT = f"""
raw AS ({LINES}),
kept AS (
  SELECT doc_id, position, text FROM raw
  WHERE len(regexp_extract_all(text, '\\.{{5,}}')) < 4 AND length(text) >= 100
    AND NOT (regexp_matches(text, '(?i)Page\\s+\\d+\\s+of\\s+\\d+')
      AND length(trim(regexp_replace(text, '(?i)Page\\s+\\d+\\s+of\\s+\\d+', ''))) < 50))"""


def _sections(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text"))
    lines = lines.select("doc_id", (F.col("p") + 1).alias("position"), "text")
    return lines.where(keep(F.col("text"), F.lit("")))


@query(f"WITH {KEPT} SELECT * FROM kept")
def sections_filter(spark, d):
    assert "Notes" in BOILERPLATE
    return _sections(spark, d)


@query(f"""
WITH {KEPT},
a AS (SELECT *, length(text) < 200 AS short, sum(CASE WHEN length(text) < 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY position) AS run FROM kept),
b AS (SELECT *, sum(short::INT) OVER (PARTITION BY doc_id, run ORDER BY position) AS n FROM a),
c AS (SELECT *, short AND n % 2 = 1 AND lead(n) OVER (PARTITION BY doc_id ORDER BY position) IS NOT NULL AS gives, lag(text) OVER (PARTITION BY doc_id ORDER BY position) AS before FROM b),
e AS (SELECT *, coalesce(lag(gives) OVER (PARTITION BY doc_id ORDER BY position), false) AS takes FROM c)
SELECT doc_id, position, CASE WHEN takes THEN before || ' ' || text ELSE text END AS text FROM e WHERE NOT gives""")
def sections_merge(spark, d):
    return merge_forward(_sections(spark, d))


@query(f"SELECT ioc, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{IOC}', 0, 'i'))) AS ioc FROM documents) GROUP BY ioc")
def ioc_extract(spark, d):
    rows = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.explode(indicators(F.col("text"))).alias("ioc"))
    return rows.groupBy("ioc").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(f"WITH {TOKENS} SELECT doc_id, len(t)::INT AS n, len(list_distinct(t))::INT AS terms FROM tok")
def tokenize_counts(spark, d):
    rows = tokenized(spread(table(spark, d, "documents").select("doc_id", "text")), "text", "t")
    return rows.select("doc_id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("terms"))


@query(r"""SELECT conv_id, turn, regexp_replace(text, '(api[_-]?key|token|authorization)\s*[=:]\s*(?:bearer\s+)?\S+', '\1=<redacted>', 'gi') AS text FROM conversations
UNION ALL SELECT doc_id, -1, regexp_replace(text, '(api[_-]?key|token|authorization)\s*[=:]\s*(?:bearer\s+)?\S+', '\1=<redacted>', 'gi') FROM documents""")
def redact_secrets(spark, d):
    said = table(spark, d, "conversations").select("conv_id", "turn", "text")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), "text")
    return said.unionByName(docs).withColumn("text", T.redact(F.col("text")))


@query(r"""
WITH t AS (SELECT conv_id, turn, '[c-' || conv_id || '] ' || text || ' [c-' || turn || '] [c-' || conv_id || '] T1059.001 T' || (1000 + turn) || ' T1059.001' AS text FROM conversations)
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\[([a-zA-Z0-9_\-]+)\]', 1))), ',') AS cited,
  array_to_string(list_sort(list_distinct(regexp_extract_all(text, 'T\d{4}(?:\.\d{3})?'))), ',') AS techniques FROM t""")
def cited_ids(spark, d):
    c, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    text = F.concat(F.lit("[c-"), c, F.lit("] "), F.col("text"), F.lit(" [c-"), t, F.lit("] [c-"), c, F.lit("] T1059.001 T"), (F.col("turn") + 1000).cast("string"), F.lit(" T1059.001"))
    joined = lambda x: F.array_join(F.array_sort(x), ",")
    return table(spark, d, "conversations").select("conv_id", "turn", joined(T.cited_ids(text)).alias("cited"), joined(T.technique_ids(text)).alias("techniques"))


@query("""
SELECT s_suppkey, 'Domain ' || lower(replace(s_name, '#', '-')) || ' is registered with ' || n_name || ' (IANA ID: ' || s_nationkey || ').'
  || CASE WHEN s_suppkey % 2 = 0 THEN ' It was created on 2020-01-' || lpad((s_suppkey % 28 + 1)::VARCHAR, 2, '0') || CASE WHEN s_suppkey % 4 = 0 THEN ' and expires on 2030.' ELSE '.' END ELSE '' END
  || CASE WHEN s_suppkey % 3 = 0 THEN ' Name servers: ns1, ns2.' ELSE '' END AS content
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def render_prose(spark, d):
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey")
    none = F.lit(None).cast("string")
    rows = rows.select(
        "s_suppkey", F.lower(F.translate("s_name", "#", "-")).alias("domain"), F.col("n_name").alias("registrar"), F.col("s_nationkey").cast("string").alias("iana_id"),
        F.when(key % 2 == 0, F.concat(F.lit("2020-01-"), F.lpad((key % 28 + 1).cast("string"), 2, "0"))).alias("created"), F.when(key % 4 == 0, "2030").alias("expires"),
        none.alias("updated"), none.alias("registrant_email"), F.when(key % 3 == 0, F.array(F.lit("ns1"), F.lit("ns2"))).alias("name_servers"), F.lit(None).cast("array<string>").alias("status"),
    )
    return rows.select("s_suppkey", feeds.whois_text().alias("content"))


#: A target without its character references, as one expression of ``x``.
UNESCAPED = r"""array_to_string(list_transform(regexp_extract_all(x, '&(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});|[^&]+|&'), lambda t:
  CASE WHEN t = '&amp;' THEN '&' WHEN t = '&lt;' THEN '<' WHEN t = '&gt;' THEN '>' WHEN t = '&quot;' THEN '"' WHEN t = '&apos;' THEN '''' WHEN lower(t[1:3]) = '&#x' THEN chr(('0x' || t[4:-2])::INT)
  WHEN starts_with(t, '&#') THEN chr(t[3:-2]::INT) ELSE t END), '')"""
LINKS = rf"""
h AS (SELECT page_id, url, list_transform(list_transform(regexp_extract_all(html, '{files.ANCHOR.replace("'", "''").removeprefix("(?i)")}', 0, 'i'),
  lambda x: regexp_replace(regexp_replace(x, '{files.ANCHOR_HEAD.removeprefix("(?i)")}', '', 'i'), '^["'']|["'']$', '', 'g')), lambda x: {UNESCAPED}) AS hs FROM pages),
u AS (SELECT page_id, url, (unnest(range(0, len(hs))))::INT AS position, unnest(hs) AS href FROM h),
l AS (
  SELECT *, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) AS site,
    regexp_extract(regexp_replace(url, '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.\-]*://[^/]*(?:/.*)?)/[^/]*$', 1) AS folder FROM u),
links AS (
  SELECT page_id, url, position, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN href
    WHEN starts_with(href, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1) || ':' || href
    WHEN starts_with(href, '/') THEN site || href
    ELSE CASE WHEN regexp_matches(folder, '://[^/]+') THEN folder ELSE site END || '/' || href END AS link FROM l)"""


@query(f"WITH {LINKS} SELECT url, position, link FROM links")
def links_extract(spark, d):
    return files.links(table(spark, d, "pages"))


@query(f"""
WITH {LINKS}, one AS (SELECT page_id % 3 AS list, position, link, url FROM links),
best AS (SELECT link, min(struct_pack(l := list, p := position)) AS b FROM one GROUP BY link),
f AS (SELECT link, b.l::INT AS list, b.p AS position, regexp_replace(array_extract(string_split(regexp_replace(regexp_replace(regexp_replace(link, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/]*', ''), '/+$', ''), '/'), -1), '[^A-Za-z0-9_.\\-]', '_', 'g') AS fn FROM best)
SELECT list, position, link, CASE WHEN fn = '' THEN 'document' ELSE fn END || CASE WHEN ends_with(lower(fn), '.pdf') THEN '' ELSE '.pdf' END AS filename FROM f""")
def url_first_wins(spark, d):
    pages = table(spark, d, "pages")
    parts = [files.links(pages.where(F.col("page_id") % 3 == n)) for n in range(3)]
    return files.first_links(parts)


@query(r"""
WITH p AS (SELECT p_partkey, ' t' || (1000 + p_partkey % 50) || CASE WHEN p_partkey % 3 = 0 THEN '.00' || (p_partkey % 7) ELSE '' END || ' ' AS raw FROM part)
SELECT p_partkey, upper(trim(raw)) AS sub, string_split(upper(trim(raw)), '.')[1] AS technique, upper(trim(raw)) = 'T1000' OR starts_with(upper(trim(raw)), 'T1000.') OR starts_with('T1000', upper(trim(raw)) || '.') AS hit FROM p""")
def normalise_ids(spark, d):
    key = F.col("p_partkey")
    tail = F.when(key % 3 == 0, F.concat(F.lit(".00"), (key % 7).cast("string"))).otherwise("")
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit(" t"), (key % 50 + 1000).cast("string"), tail, F.lit(" ")).alias("raw"))
    raw = F.col("raw")
    return rows.select("p_partkey", T.technique(raw, "subtechnique").alias("sub"), T.technique(raw).alias("technique"), T.same_technique(raw, F.lit("t1000")).alias("hit"))
