"""Threat feeds: pulses, WHOIS, passive DNS and scan results, each from its JSON shape to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fathom.functions.text import iso_from_epoch, or_empty, strip
from fathom.operators.keyed import first_by_key
from fathom.sources import documents

IN_CONTENT, IN_METADATA = 20, 50
PULSE = (
    "id string, name string, description string, modified string, pulse_source string, adversary string, tags array<string>, attack_ids array<struct<id:string,name:string>>, "
    "indicators array<struct<indicator:string,type:string>>, malware_families array<string>, targeted_countries array<string>, references array<string>"
)
WHOIS = "domain string, registrar string, iana_id string, created string, expires string, updated string, registrant_email string, name_servers array<string>, status array<string>"
PDNS = "domain string, first_seen string, last_seen string, resolutions array<struct<ip:string,asn:string,asn_name:string,first_seen:string,last_seen:string>>, subdomains array<string>"
SCAN = "data struct<id:string,attributes:struct<last_analysis_stats:map<string,int>,crowdsourced_yara_results:array<struct<rule_name:string>>,tags:array<string>,last_modification_date:bigint>>"
WHOXY_RECORD = "status int, status_reason string, domain_name string, create_date string, update_date string, expiry_date string, domain_registrar struct<iana_id:string,registrar_name:string>, registrant_contact struct<full_name:string,email_address:string>, name_servers array<string>, domain_status array<string>"


def _text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _when(c: Column, made: Column) -> Column:
    """``made`` where ``c`` is not empty, else null, which concat_ws leaves out."""
    return F.when(F.coalesce(c, F.lit("")) != "", made)


def _list(c: Column, before: str, after: str = ".") -> Column:
    return F.when(F.size(c) > 0, F.concat(F.lit(before), F.array_join(c, ", "), F.lit(after)))


def family_names(families: Column) -> Column:
    """Names from a mixed list read as strings: plain ones, or objects with a display name."""
    named = F.transform(or_empty(families), lambda x: F.when(F.startswith(F.ltrim(x), F.lit("{")), F.get_json_object(x, "$.display_name")).otherwise(x))
    return F.filter(named, lambda x: F.coalesce(x, F.lit("")) != "")


def pulses(rows: DataFrame, watch: Observation | None = None) -> DataFrame:
    """Pulses as documents. Of pulses with one id the first (column ``seq``, if any) counts."""
    if "seq" in rows.columns:
        rows = first_by_key(rows, ["id"], "seq")
    seen = F.filter(F.transform("indicators", lambda i: i["indicator"]), lambda x: F.coalesce(x, F.lit("")) != "")
    seen = F.coalesce(seen, F.array().cast("array<string>"))
    families, countries = family_names(F.col("malware_families")), or_empty(F.col("targeted_countries"))
    content = F.concat_ws(
        "\n\n", F.nullif(_text("name"), F.lit("")), F.nullif(strip(_text("description")), F.lit("")),
        _when(F.col("adversary"), F.concat(F.lit("Attributed to "), F.col("adversary"), F.lit("."))),
        _list(families, "Associated malware: "), _list(countries, "Targeted countries: "), _list(F.slice(seen, 1, IN_CONTENT), "Key indicators: "),
    )
    metadata = {
        "pulse_id": _text("id"), "name": _text("name"), "tags": or_empty(F.col("tags")), "attack_ids": F.col("attack_ids"), "adversary": _text("adversary"), "malware_families": families,
        "targeted_countries": countries, "references": or_empty(F.col("references")), "indicators": F.slice(seen, 1, IN_METADATA), "last_modified": _text("modified"), "pulse_source": _text("pulse_source"),
    }
    return documents(rows, "otx", "otx", F.col("id"), content, metadata, pulse_id=F.col("id"), watch=watch)


def whois_text(r: str = "") -> Column:
    """A WHOIS record as sentences; missing parts are left out."""
    c = lambda n: F.col(r + n)
    registrar = F.coalesce(c("registrar"), F.lit("unknown registrar"))
    registrar = F.when(_text(c("iana_id")) != "", F.concat(registrar, F.lit(" (IANA ID: "), c("iana_id"), F.lit(")"))).otherwise(registrar)
    expires = F.when(_text(c("expires")) != "", F.concat(F.lit(" and expires on "), c("expires"), F.lit("."))).otherwise(".")
    return F.concat_ws(
        " ", F.concat(F.lit("Domain "), F.coalesce(c("domain"), F.lit("unknown domain")), F.lit(" is registered with "), registrar, F.lit(".")),
        _when(c("created"), F.concat(F.lit("It was created on "), c("created"), expires)),
        _when(c("updated"), F.concat(F.lit("Last updated: "), c("updated"), F.lit("."))),
        _when(c("registrant_email"), F.concat(F.lit("Registrant contact email: "), c("registrant_email"), F.lit("."))),
        _list(c("name_servers"), "Name servers: "), _list(c("status"), "Registration status: "),
    )


def whois(rows: DataFrame, watch: Observation | None = None) -> DataFrame:
    metadata = {n: F.col(n) for n in ("domain", "registrar", "iana_id", "created", "expires", "registrant_email", "name_servers")}
    return documents(rows, "whois", "whois", F.nullif(F.col("domain"), F.lit("")), whois_text(), metadata, watch=watch)


def whois_lookups(rows: DataFrame) -> DataFrame:
    """Provider payloads (WHOXY_RECORD) to WHOIS records; failed lookups and those without a domain fall out."""
    domain = F.lower(F.trim(_text("domain_name")))
    return rows.where((F.col("status") == 1) & (domain != "")).select(
        domain.alias("domain"), _text("domain_registrar.registrar_name").alias("registrar"), _text("domain_registrar.iana_id").alias("iana_id"),
        _text("create_date").alias("created"), _text("expiry_date").alias("expires"), _text("update_date").alias("updated"),
        _text("registrant_contact.email_address").alias("registrant_email"), or_empty(F.col("name_servers")).alias("name_servers"), or_empty(F.col("domain_status")).alias("status"),
    )


def whois_history(rows: DataFrame) -> DataFrame:
    """Histories (status, domain_name, whois_records with query_time) to the record of each one's latest snapshot, the first of equals."""
    latest = F.aggregate(
        F.slice("whois_records", 2, 1_000_000), F.element_at("whois_records", 1),
        lambda a, r: F.when(_text(r["query_time"]) > _text(a["query_time"]), r).otherwise(a),
    )
    rows = rows.where((F.col("status") == 1) & (F.size("whois_records") > 0)).select(F.col("domain_name").alias("_own"), latest.alias("r"))
    own = F.when(F.trim(_text("r.domain_name")) == "", F.col("_own")).otherwise(F.col("r.domain_name"))
    names = [f.name for f in rows.schema["r"].dataType.fields if f.name not in ("status", "domain_name")]
    return whois_lookups(rows.select(F.lit(1).alias("status"), own.alias("domain_name"), *[F.col(f"r.{n}").alias(n) for n in names]))


def passive_dns(rows: DataFrame, watch: Observation | None = None) -> DataFrame:
    resolutions = F.coalesce("resolutions", F.array().cast("array<struct<ip:string,asn:string,asn_name:string,first_seen:string,last_seen:string>>"))
    shown = F.transform(
        F.slice(resolutions, 1, 10),
        lambda r: F.concat(
            _text(r["ip"]),
            F.when(_text(r["asn"]) != "", F.concat(F.lit(" ("), r["asn"], F.when(_text(r["asn_name"]) != "", F.concat(F.lit(" / "), r["asn_name"])).otherwise(""), F.lit(")"))).otherwise(""),
            F.when((_text(r["first_seen"]) != "") & (_text(r["last_seen"]) != ""), F.concat(F.lit(" seen "), r["first_seen"], F.lit(" to "), r["last_seen"])).otherwise(""),
        ),
    )
    content = F.concat_ws(
        " ", F.concat(F.lit("Passive DNS history for domain "), F.col("domain"), F.lit(".")),
        F.when((_text("first_seen") != "") & (_text("last_seen") != ""), F.concat(F.lit("Observed from "), F.col("first_seen"), F.lit(" to "), F.col("last_seen"), F.lit("."))),
        F.when(F.size(resolutions) > 0, F.concat(F.lit("IP resolutions: "), F.array_join(shown, "; "), F.lit("."))),
        _list(F.slice(or_empty(F.col("subdomains")), 1, 10), "Known subdomains: "),
    )
    filled = lambda f: F.filter(F.transform(resolutions, lambda r: r[f]), lambda x: F.coalesce(x, F.lit("")) != "")
    metadata = {
        "domain": F.col("domain"), "first_seen": _text("first_seen"), "last_seen": _text("last_seen"), "ip_addresses": F.slice(filled("ip"), 1, 20),
        "asns": F.slice(F.array_sort(F.array_distinct(filled("asn"))), 1, 10), "subdomains": F.slice(or_empty(F.col("subdomains")), 1, 20),
    }
    return documents(rows, "pdns", "pdns", F.nullif(F.col("domain"), F.lit("")), content, metadata, watch=watch)


def scans(rows: DataFrame, watch: Observation | None = None) -> DataFrame:
    a, stats = F.col("data.attributes"), F.col("data.attributes.last_analysis_stats")
    count = lambda k: F.coalesce(F.try_element_at(stats, F.lit(k)), F.lit(0)).cast("string")
    total = F.aggregate(F.map_values(stats), F.lit(0), lambda s, x: s + x).cast("string")
    rules = F.filter(F.transform(F.slice(a["crowdsourced_yara_results"], 1, 5), lambda r: r["rule_name"]), lambda x: F.coalesce(x, F.lit("")) != "")
    detected = F.concat(F.lit("Detection: "), count("malicious"), F.lit(" malicious, "), count("suspicious"), F.lit(" suspicious, "), count("harmless"), F.lit(" harmless out of "), total, F.lit(" engines."))
    content = F.concat_ws(
        " ", F.concat(F.lit("VirusTotal analysis of domain "), F.col("data.id"), F.lit(".")), F.when(F.size(stats) > 0, detected),
        _list(rules, "Matched YARA rules: "), _list(a["tags"], "Tags: "),
    )
    metadata = {"domain": F.col("data.id"), "tags": or_empty(a["tags"]), "last_modified": iso_from_epoch(a["last_modification_date"]), "analysis_stats": stats}
    return documents(rows, "virustotal", "vt", F.nullif(F.col("data.id"), F.lit("")), content, metadata, watch=watch)
