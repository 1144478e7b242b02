"""STIX bundles: techniques, relationships, and the graph they span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fathom.functions.text import strip
from fathom.sources import documents

OBJECT = (
    "struct<type:string,id:string,name:string,description:string,aliases:array<string>,external_references:array<struct<source_name:string,external_id:string>>,"
    "kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>,x_mitre_platforms:array<string>,x_mitre_is_subtechnique:boolean,"
    "modified:string,revoked:boolean,x_mitre_deprecated:boolean,relationship_type:string,source_ref:string,target_ref:string,spec_version:string>"
)
CHAIN = "mitre-attack"


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """One row an object with its ``position`` in the bundle. A missing file is an error."""
    bundle = spark.read.schema(f"objects array<{OBJECT}>").option("multiLine", True).json(path)
    return bundle.select(F.posexplode("objects").alias("position", "o")).select("position", "o.*")


def external_id(references: Column) -> Column:
    """The first id from the technique knowledge base, or null."""
    return F.try_element_at(F.filter(references, lambda r: r["source_name"] == CHAIN), F.lit(1))["external_id"]


def tactics(phases: Column) -> Column:
    own = F.filter(F.coalesce(phases, F.array().cast("array<struct<kill_chain_name:string,phase_name:string>>")), lambda p: p["kill_chain_name"] == CHAIN)
    return F.transform(own, lambda p: p["phase_name"])


def techniques(objects: DataFrame, watch: Observation | None = None) -> DataFrame:
    """Techniques that are not revoked, as documents; deprecated ones stay."""
    rows = objects.where((F.col("type") == "attack-pattern") & ~F.coalesce("revoked", F.lit(False)))
    attack = F.coalesce(external_id(F.col("external_references")), F.col("id"), F.lit("unknown"))
    phases = tactics(F.col("kill_chain_phases"))
    listed = F.when(F.size(phases) > 0, F.array_join(phases, ", ")).otherwise("unknown")
    content = F.concat(attack, F.lit(": "), F.coalesce("name", F.lit("")), F.lit("\nTactics: "), listed, F.lit("\n\n"), strip(F.coalesce("description", F.lit(""))))
    metadata = {
        "attack_id": attack, "name": F.col("name"), "tactics": phases, "platforms": F.coalesce("x_mitre_platforms", F.array().cast("array<string>")),
        "is_subtechnique": F.coalesce("x_mitre_is_subtechnique", F.lit(False)), "last_modified": F.coalesce("modified", F.lit("")), "stix_id": F.col("id"),
    }
    return documents(rows, "mitre", "mitre", attack, content, metadata, attack_id=attack, watch=watch)


def nodes(objects: DataFrame) -> DataFrame:
    """Everything but edges; of objects with one id the last counts."""
    rows = objects.where("type <> 'relationship' AND id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("position", "type", "name", "aliases", "external_references", "kill_chain_phases", "revoked", "x_mitre_deprecated"), "position").alias("n"))
    return rows.select(
        "id", "n.position", "n.type", "n.name", "n.aliases", external_id(F.col("n.external_references")).alias("external_id"),
        F.col("n.kill_chain_phases").alias("phases"), "n.revoked", F.col("n.x_mitre_deprecated").alias("deprecated"),
    )


def edges(objects: DataFrame) -> DataFrame:
    """All edges (src, rel, dst); whether they are revoked does not matter here."""
    return objects.where("type = 'relationship'").select(F.col("source_ref").alias("src"), F.col("relationship_type").alias("rel"), F.col("target_ref").alias("dst"))


def relationships(objects: DataFrame, watch: Observation | None = None) -> DataFrame:
    """Uses and attributions of groups and campaigns as documents; edges to unknown objects are skipped and counted."""
    node = nodes(objects)
    source = node.where(F.col("type").isin("intrusion-set", "campaign")).select(F.col("id").alias("source_ref"), F.col("name").alias("source_name"))
    target = node.select(F.col("id").alias("target_ref"), F.col("name").alias("target_name"), F.col("type").alias("target_type"), F.when(F.col("type") == "attack-pattern", F.col("external_id")).alias("target_attack"))
    kept = (F.col("type") == "relationship") & ~F.coalesce("revoked", F.lit(False)) & F.col("relationship_type").isin("uses", "attributed-to")
    rows = objects.where(kept).select(F.col("id").alias("edge_id"), "relationship_type", "source_ref", "target_ref", "description")
    rows = rows.join(source, "source_ref").join(target, "target_ref", "left")
    technique = F.col("target_attack").isNotNull()
    verb = F.when(~technique & (F.col("relationship_type") == "attributed-to"), " attributed-to ").otherwise(" uses ")
    line = F.concat(F.col("source_name"), verb, F.col("target_name"), F.when(technique, F.concat(F.lit(" ("), F.col("target_attack"), F.lit(")"))).otherwise(""))
    body = strip(F.coalesce("description", F.lit("")))
    content = F.concat(line, F.when(body != "", F.concat(F.lit("\n\n"), body)).otherwise(""))
    metadata = {
        "attack_id": F.coalesce("target_attack", F.lit("")), "relationship_type": F.col("relationship_type"), "source_name": F.col("source_name"),
        "target_name": F.col("target_name"), "stix_id": F.col("edge_id"),
    }
    return documents(rows, "mitre", "mitre-rel", F.col("edge_id"), content, metadata, attack_id=F.col("target_attack"), valid=F.col("target_name").isNotNull(), watch=watch)
