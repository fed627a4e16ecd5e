"""Listed addresses from the published sanctions XML, and seed lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.functions.scripts import looks_like_address

FEATURE = "Digital Currency Address - "
_NAME = "array<struct<DocumentedNamePart:array<struct<NamePartValue:array<string>>>>>"
PARTY = (
    "_FixedRef string, Profile array<struct<"
    f"Identity:array<struct<Alias:array<struct<_Primary:string,DocumentedName:{_NAME}>>>>,"
    "Feature:array<struct<_FeatureTypeID:string,FeatureVersion:array<struct<VersionDetail:array<struct<_VALUE:string,_DetailTypeID:string>>>>>>>>"
)


def _xml(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).option("ignoreNamespace", "true").option("mode", "PERMISSIVE").schema(schema).load(path)


def feature_types(spark: SparkSession, path: str) -> DataFrame:
    """(id, label) of the file's feature types."""
    rows = _xml(spark, path, "FeatureType", "_ID string, _VALUE string")
    return rows.select(F.col("_ID").alias("id"), F.trim("_VALUE").alias("label")).where("id IS NOT NULL")


def listed_addresses(spark: SparkSession, path: str, ticker: str = "XBT") -> tuple[DataFrame, DataFrame]:
    """(address, sdn_ref, sdn_name) of a currency, distinct and in order; and (value) of rejected entries (XBT only).

    An entry's name is its first primary alias that has parts, or else its first alias that has. A ticker that the file
    doesn't define is a ValueError.
    """
    types = feature_types(spark, path).where(F.col("label") == FEATURE + ticker).select("id")
    if types.isEmpty():
        raise ValueError(f"{FEATURE + ticker!r} is not a feature type of this file")
    parties = _xml(spark, path, "DistinctParty", PARTY)
    profile = parties.withColumn("p", F.explode("Profile"))
    aliases = F.flatten(F.transform(F.coalesce("p.Identity", F.expr("cast(array() as array<struct<Alias:array<struct<_Primary:string,DocumentedName:" + _NAME + ">>>>)")), lambda i: F.coalesce(i["Alias"], F.expr("cast(array() as array<struct<_Primary:string,DocumentedName:" + _NAME + ">>)"))))
    named = profile.withColumn("aliases", aliases)
    parts = F.expr(
        "transform(aliases, a -> named_struct('first', coalesce(a._Primary, '') = 'true', 'name', array_join(filter(transform(flatten(transform(flatten(transform("
        "coalesce(a.DocumentedName, array()), d -> coalesce(d.DocumentedNamePart, array()))), x -> coalesce(x.NamePartValue, array()))), v -> trim(v)), v -> v <> ''), ' ')))"
    )
    named = named.withColumn("names", F.filter(parts, lambda n: n["name"] != ""))
    primary = F.filter("names", lambda n: n["first"])
    name = F.coalesce(F.try_element_at(primary, F.lit(1))["name"], F.try_element_at("names", F.lit(1))["name"], F.lit(""))
    rows = named.select(F.coalesce("_FixedRef", F.lit("")).alias("sdn_ref"), name.alias("sdn_name"), F.explode("p.Feature").alias("f"))
    rows = rows.join(F.broadcast(types), F.col("f._FeatureTypeID") == F.col("id"), "left_semi")  # a few ids per ticker
    rows = rows.select("sdn_ref", "sdn_name", F.explode("f.FeatureVersion").alias("v")).select("sdn_ref", "sdn_name", F.explode("v.VersionDetail").alias("d"))
    rows = rows.select(F.trim("d._VALUE").alias("address"), "sdn_ref", "sdn_name").where("address <> ''").distinct()
    good = looks_like_address(F.col("address")) if ticker == "XBT" else F.lit(True)
    return rows.where(good).orderBy("address", "sdn_ref", "sdn_name"), rows.where(~good).select(F.col("address").alias("value")).distinct().orderBy("value")


#: Seeds in the order of their file: ``place`` says which comes first.
SEEDS = "place long, address string, sdn_ref string, sdn_name string"


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """SEEDS of a JSON report with ``addresses``, or of a text file with one address a line and # comments."""
    if path.endswith(".json"):
        rows = spark.read.schema("addresses array<struct<address:string,sdn_ref:string,sdn_name:string>>").option("multiLine", "true").json(path)
        return rows.select(F.posexplode("addresses").alias("place", "a")).select(F.col("place").cast("long").alias("place"), "a.*")
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("place"), F.trim(F.regexp_replace("value", "#.*", "")).alias("address")).where("address <> ''")
    return lines.select("place", "address", F.lit(None).cast("string").alias("sdn_ref"), F.lit(None).cast("string").alias("sdn_name"))


def of_entry(seeds: DataFrame, sdn_ref: str | None) -> DataFrame:
    """The seeds of one entry, or all; an entry without any is a ValueError."""
    if sdn_ref is None:
        return seeds
    own = seeds.where(F.col("sdn_ref") == sdn_ref)
    if own.isEmpty():
        raise ValueError(f"no seed addresses for entry {sdn_ref}")
    return own


def select_seeds(seeds: DataFrame) -> DataFrame:
    """(address, sdn_ref, sdn_name), one row per address of SEEDS: the reference that comes first and the name that comes last.

    Rows without a reference name nothing. No address at all is a ValueError.
    """
    ref = F.nullif("sdn_ref", F.lit(""))
    name = F.when(ref.isNotNull(), F.nullif("sdn_name", F.lit("")))
    first = F.min(F.when(ref.isNotNull(), F.struct("place", ref.alias("x"))))
    last = F.max(F.when(name.isNotNull(), F.struct("place", name.alias("x"))))
    out = seeds.groupBy("address").agg(first.alias("first"), last.alias("last")).select("address", F.col("first.x").alias("sdn_ref"), F.col("last.x").alias("sdn_name"))
    if out.isEmpty():
        raise ValueError("no seed addresses")
    return out
