"""URL filters: rules indexed by their rarest literal token, in DataFrame functions only.

A URL's tokens are its maximal runs of ``[a-z0-9]`` once A-Z are lower-cased. Every rule is filed
under one token that any URL it can match must hold whole; a URL's tokens fetch the rules filed
under them, and only those run their regular expression. Which of a rule's tokens is the rarest is
counted over all URLs of the table.

Two kinds of rule share the index. A *site rule* has an action, a host and a path: it fits the host
and its subdomains where the URL's path starts with the rule's; the longest (host and path
together; then the longer host, then the greater text) wins over shorter ones and over all pattern
rules. A *pattern rule* is written as in public blocking lists: ``||`` starts at a host label,
``|`` is an end of the URL, ``^`` a separator or the end, ``*`` anything, ``@@`` in front allows.
An allowing pattern beats a blocking one; a URL that nothing matches is allowed.

Defined cases: a null URL, an empty one or one without ``://`` has an empty host and path, no site
rule, and is allowed unless a pattern matches its text. Repeated rows are judged alike and all kept; an empty
table gives an empty result; extra columns are kept, and a result column replaces one of its name.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of pattern rules used where no site rule fits.
PATTERNS = (
    "||casino-win.",
    "||free-bets.",
    "||cheap-pills.",
    "/adserver/",
    "^popunder^",
    "@@||example.org^help^",
)
#: Up to so many rules the index is a literal in the plan; a larger one is a table that is joined.
LITERAL_RULES = 64
TOKEN = re.compile(r"[a-z0-9]+")
OUT = ("host", "path", "rule", "verdict")


@dataclass(frozen=True)
class Rule:
    action: str
    text: str
    regex: str
    #: Whether the expression runs on host and path, not on the whole URL.
    site: bool
    tokens: tuple[str, ...]
    size: int = 0
    host_size: int = 0


def quoted(text: str) -> str:
    """``text`` as a regular expression that Java and RE2 read alike."""
    return "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in text)


def lower(text: str) -> str:
    return "".join(c.lower() if c in string.ascii_uppercase else c for c in text)


def site_rule(action: str, text: str) -> Rule:
    """``com/en/``: the host up to the first slash, then the path."""
    host, slash, rest = text.partition("/")
    host, path = lower(host), slash + rest
    inner = [m for m in TOKEN.finditer(lower(path)) if m.end() < len(path)]
    tokens = tuple(m.group() for m in TOKEN.finditer(host)) + tuple(m.group() for m in inner)
    end = "(?:/|$)" if not path else quoted(path)
    return Rule(action, host + path, rf"^(?:[^/]*\.)?{quoted(host)}{end}", True, tokens, len(host + path), len(host))


def pattern_rule(text: str) -> Rule:
    """A rule in the notation of public blocking lists."""
    action, body = ("allow", text[2:]) if text.startswith("@@") else ("block", text)
    body = lower(body)
    regex, bound = "", body.startswith("|")
    if body.startswith("||"):
        regex, body = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        regex, body = "^", body[1:]
    tail = body.endswith("|")
    body = body[: len(body) - tail]
    tokens = []
    for m in TOKEN.finditer(body):
        left = bound if not m.start() else body[m.start() - 1] != "*"
        right = tail if m.end() == len(body) else body[m.end()] != "*"
        if left and right:
            tokens.append(m.group())
    for c in body:
        regex += {"*": ".*", "^": r"(?:[^a-z0-9_.%\-]|$)"}.get(c) or quoted(c)
    return Rule(action, text, regex + "$" * tail, False, tuple(tokens))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(ascii_lower(url), "[^a-z0-9]+"), lambda t: t != ""))


def token_counts(urls: DataFrame, url: str, tokens: set[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens occurs: one row for each of these at most."""
    kept = F.filter(url_tokens(F.col(url)), lambda t: t.isin(sorted(tokens)))
    rows = urls.select(F.explode(kept).alias("t")).groupBy("t").count()
    return {r["t"]: r["count"] for r in rows.collect()}


def filed(rules: list[Rule], counts: dict[str, int]) -> list[tuple[str, Rule]]:
    """Each rule with its rarest token; ties go to fewer rules under it, the longer, the lesser token. "" where it has none."""
    shared = Counter(t for r in rules for t in set(r.tokens))
    key = lambda t: (counts.get(t, 0), shared[t], -len(t), t)
    return [(min(r.tokens, key=key) if r.tokens else "", r) for r in rules]


def _order(rule: Rule) -> tuple:
    """Greater wins: site rules, then their length; an allowing pattern before a blocking one."""
    return (int(rule.site), rule.size, rule.host_size if rule.site else int(rule.action == "allow"), rule.text)


def _struct(rule: Rule) -> Column:
    site, size, host, text = _order(rule)
    return F.struct(
        F.lit(site).alias("site"), F.lit(size).alias("size"), F.lit(host).alias("second"),
        F.lit(text).alias("text"), F.lit(rule.action).alias("action"), F.lit(rule.regex).alias("regex"),
    )


def judge(df: DataFrame, sites: list[Rule], patterns: list[Rule], url: str = "url") -> DataFrame:
    """``df`` with host, path, rule (the site rule that decides, else null), verdict and matched (the deciding rule of either kind)."""
    rules, given = [*sites, *patterns], df.columns
    df = df.toDF(*[f"_extra_{i}" if c in ("_best", "_url") and c != url else c for i, c in enumerate(given)])
    names = dict(zip(df.columns, given, strict=True))
    df = df.drop(*[c for c in (*OUT, "matched") if c != url and c in df.columns])
    host, path = host_and_path(F.col(url))
    counts = token_counts(df, url, {t for r in rules for t in r.tokens}) if len(rules) <= LITERAL_RULES and rules else {}
    if len(rules) <= LITERAL_RULES:
        best = _by_literal(filed(rules, counts), F.col(url), F.concat(host, path))
        df = df.withColumn("_best", best)
    else:
        df = _by_join(df, rules, url)
    b = F.col("_best")
    return df.select(
        *[F.col(f"`{c}`").alias(names[c]) for c in df.columns if c != "_best"],
        host.alias("host"), path.alias("path"),
        F.when(b["site"] == 1, b["text"]).alias("rule"),
        F.coalesce(b["action"], F.lit("allow")).alias("verdict"), b["text"].alias("matched"),
    )


def _fits(rule: Column, url: Column, at: Column) -> Column:
    return F.rlike(F.when(rule["site"] == 1, at).otherwise(ascii_lower(url)), rule["regex"])


def _by_literal(index: list[tuple[str, Rule]], url: Column, at: Column) -> Column:
    if not index:
        return F.lit(None).cast("struct<site:int,size:int,second:int,text:string,action:string,regex:string>")
    by: dict[str, list[Rule]] = {}
    for token, rule in index:
        by.setdefault(token, []).append(rule)
    held = {t: F.array(*[_struct(r) for r in rs]) for t, rs in by.items()}
    general = held.pop("", None)
    parts = []
    if held:
        table = F.create_map(*[x for t, rs in held.items() for x in (F.lit(t), rs)])
        known = F.array(*[F.lit(t) for t in held])
        parts.append(F.flatten(F.transform(F.array_intersect(url_tokens(url), known), lambda t: F.element_at(table, t))))
    if general is not None:
        parts.append(general)
    fetched = F.concat(*parts) if len(parts) > 1 else parts[0]
    return F.array_max(F.filter(fetched, lambda r: _fits(r, url, at)))


def _by_join(df: DataFrame, rules: list[Rule], url: str) -> DataFrame:
    """The same over a table of rules; tokens are counted, filed and fetched by joins."""
    spark = df.sparkSession
    rows = [(n, *_order(r), r.action, r.regex, sorted(set(r.tokens))) for n, r in enumerate(rules)]
    table = spark.createDataFrame(rows, "n int, site int, size int, second int, text string, action string, regex string, tokens array<string>")
    urls = df.select(F.col(url).alias("_url")).where(F.col("_url").isNotNull()).distinct()
    seen = urls.select("_url", F.explode(url_tokens(F.col("_url"))).alias("token"))
    own = table.select("n", F.explode("tokens").alias("token"))
    counts = seen.join(own.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rarest = own.join(counts, "token", "left").groupBy("n").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    index = table.join(rarest, "n", "left").drop("n", "tokens")
    rule = F.struct("site", "size", "second", "text", "action", "regex")
    fetched = seen.join(index.where("token is not null"), "token")
    loose = [r for r in rules if not r.tokens]
    host, path = host_and_path(F.col("_url"))
    hits = fetched.where(_fits(rule, F.col("_url"), F.concat(host, path))).select("_url", rule.alias("_best"))
    if loose:
        few = urls.withColumn("_best", _by_literal([("", r) for r in loose], F.col("_url"), F.concat(host, path)))
        hits = hits.unionByName(few.where("_best is not null"))
    best = hits.groupBy("_url").agg(F.max("_best").alias("_best"))
    return df.join(best, F.col(url) == F.col("_url"), "left").drop("_url")
