"""Lookups that add names and attack knowledge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve import fixed
from flowsieve.functions import scoring as S
from flowsieve.session import literal_table

TECHNIQUE = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "name", "url")])
TACTIC = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "name")])
TACTIC_FULL = T.StructType([*TACTIC.fields, T.StructField("techniques", T.ArrayType(TECHNIQUE))])
KB_SCHEMA = T.StructType([
    T.StructField("category", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("tactics", T.ArrayType(TACTIC_FULL)),
])


def default_kb(spark: SparkSession) -> DataFrame:
    """The knowledge base that ships with the package, one row per category."""
    def technique(t, name):
        return {"id": t, "name": name, "url": fixed.technique_url(t)}

    rows = [
        (cat, text, [{"id": i, "name": n, "techniques": [technique(*t) for t in techs]} for i, n, techs in tactics])
        for cat, text, tactics in fixed.ATTACK_KB
    ]
    return literal_table(spark, rows, KB_SCHEMA)


def kb_lookup(kb: DataFrame) -> DataFrame:
    """category → tactics (id, name) and the techniques of all its tactics in one list."""
    flat = F.flatten(F.transform("tactics", lambda t: t["techniques"]))
    return kb.select(
        F.col("category").alias("kb_category"),
        F.transform("tactics", lambda t: F.struct(t["id"].alias("id"), t["name"].alias("name"))).alias("kb_tactics"),
        flat.alias("kb_techniques"),
    )


def enrich_attack(df: DataFrame, kb: DataFrame, min_confidence: float = fixed.MIN_ATTACK_CONFIDENCE) -> DataFrame:
    """Adds struct ``mitre``: tactics, techniques and band for Malicious rows that are confident enough.

    A leaf without an entry gets an ``unmapped`` stub, everything else null. The knowledge base has one row per attack
    category; Spark sees its size and broadcasts it.
    """
    wanted = (F.col("prediction") == "Malicious") & (F.col("confidence") >= min_confidence) & F.col("attack_type").isNotNull()
    d = df.withColumn("_leaf", F.when(wanted, F.col("attack_type")))
    j = d.join(kb_lookup(kb), F.col("_leaf") == F.col("kb_category"), "left")
    unmapped = F.col("kb_category").isNull()
    text = F.concat(F.lit("No attack mapping for '"), F.col("_leaf"), F.lit("'."))
    mitre = F.struct(
        S.confidence_band("confidence").alias("confidence_band"),
        F.coalesce("kb_tactics", F.array().cast(T.ArrayType(TACTIC))).alias("tactics"),
        F.coalesce("kb_techniques", F.array().cast(T.ArrayType(TECHNIQUE))).alias("techniques"),
        unmapped.alias("unmapped"),
        F.when(unmapped, F.col("_leaf")).alias("attack_type"),
        F.when(unmapped, text).alias("description"),
    )
    return j.select(*df.columns, F.when(F.col("_leaf").isNotNull(), mitre).alias("mitre"))


def first_tactic(mitre: str | Column) -> Column:
    """Name (else id) of the first tactic, empty text without one."""
    m = F.col(mitre) if isinstance(mitre, str) else mitre
    first = F.try_element_at(m["tactics"], F.lit(1))
    return F.coalesce(first["name"], first["id"], F.lit(""))


def with_usernames(df: DataFrame, users: DataFrame, by: str = "ack_by", name: str = "ack_by_name") -> DataFrame:
    """User id to username; unknown or missing ids give null. Spark broadcasts the directory if it is small."""
    u = users.select(F.col("id").alias("_uid"), F.col("username").alias(name))
    return df.join(u, F.col(by) == F.col("_uid"), "left").drop("_uid")


def services(spark: SparkSession) -> DataFrame:
    return literal_table(spark, list(fixed.PORT_SERVICES.items()), "service_port int, service string")


def with_service(df: DataFrame, port: str = "destination_port") -> DataFrame:
    """Service name of a port, empty text if unknown. The table is fixed at 45 rows, so it is broadcast."""
    dim = F.broadcast(services(df.sparkSession))
    j = df.join(dim, F.col(port) == F.col("service_port"), "left")
    return j.withColumn("service", F.coalesce("service", F.lit(""))).drop("service_port")


def families(spark: SparkSession) -> DataFrame:
    return literal_table(spark, list(fixed.FAMILY_OF_LEAF.items()), "_of_leaf string, _of_family string")


def with_family(df: DataFrame, label: str = "label", name: str = "family", strict: bool = True) -> DataFrame:
    """Leaf label to family (15 fixed rows, broadcast). With ``strict`` an unknown label stops the job when its row is
    read, so no extra pass is needed to find it."""
    j = df.join(F.broadcast(families(df.sparkSession)), F.col(label) == F.col("_of_leaf"), "left")
    value = F.col("_of_family")
    if strict:
        message = F.concat(F.lit("label without family: "), F.coalesce(F.col(label), F.lit("null")))
        value = F.coalesce(value, F.raise_error(message).cast("string"))
    return j.withColumn(name, value).drop("_of_leaf", "_of_family")


def search_kb(kb: DataFrame, tactic: str | None = None, text: str | None = None) -> DataFrame:
    """Categories with the tactic id and with the text in their name, description, tactic names or techniques."""
    out = kb
    if tactic:
        out = out.filter(F.exists("tactics", lambda t: t["id"] == tactic))
    needle = (text or "").strip() and (text or "").lower()
    if needle:
        has = lambda c: F.lower(c).contains(needle)
        deep = F.exists(
            "tactics",
            lambda t: has(t["name"]) | F.exists(t["techniques"], lambda k: has(k["name"]) | has(k["id"])),
        )
        out = out.filter(has(F.col("category")) | has(F.col("description")) | deep)
    return out


def kb_coverage(kb: DataFrame) -> DataFrame:
    """How many tactics and techniques the knowledge base names."""
    flat = kb.select(F.explode("tactics").alias("t")).select(F.col("t.id").alias("tactic"), F.explode("t.techniques").alias("k"))
    return flat.agg(
        F.count_distinct("tactic").alias("tactics"), F.count_distinct(F.col("k.id")).alias("techniques"),
    )


def leaves_without_mapping(df: DataFrame, kb: DataFrame) -> DataFrame:
    """Attack leaves in the data that the knowledge base does not know, with their row counts."""
    seen = df.filter("attack_type is not null").groupBy("attack_type").agg(F.count("*").alias("rows"))
    return seen.join(kb.select(F.col("category").alias("attack_type")), "attack_type", "left_anti")
