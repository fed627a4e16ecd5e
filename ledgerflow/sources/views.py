"""Ledger tables laid over a star schema of orders and line items, for tests and benchmarks.

An order is a transaction, its returned lines are inputs, its other lines outputs, parts are addresses; line items are
unspent outputs too. The stand-ins have a ledger's structure, not its meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.functions.scripts import key_hash, once, script_type
from ledgerflow.operators.ledger import Ledger

EPOCH = "1995-01-01"
TYPES = ("pubkeyhash", "scripthash", "witness_v0_keyhash", "witness_v0_scripthash")
BIN_DAYS, DORMANT_DAYS = 100, 365
#: What a line is ordered by, and its value.
LINE = ("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "sats")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _txid(key) -> Column:
    return F.sha2(F.concat(F.lit("o"), key.cast("string")), 256)


def _days(column) -> Column:
    return F.datediff(F.to_date(column), F.lit(EPOCH).cast("date"))


def _address(part: Column) -> Column:
    return F.concat(F.lit("P"), part.cast("string"))


def _type(part: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TYPES)), ((part % 11) % 4 + 1).cast("int"))


def _sats() -> Column:
    return ((F.floor((F.col("l_quantity") - 1) / 5) + 1) * 1000).cast("long")


def _lines(lines: DataFrame) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return lines.select(
        _txid(F.col("l_orderkey")).alias("txid"),
        (F.row_number().over(order) - 1).alias("i"),
        _address(F.col("l_partkey")).alias("address"),
        _type(F.col("l_partkey")).alias("type"),
        _sats().alias("sats"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag")
    ins, outs = lines.where("l_returnflag = 'A'"), lines.where("l_returnflag IN ('N', 'R')")
    counts = lines.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag").isin("N", "R")).alias("b"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").fillna(0, ["a", "b"])
    tx = orders.select(
        _txid(F.col("o_orderkey")).alias("txid"),
        _days("o_orderdate").alias("height"),
        F.col("o_orderkey").alias("tx_index"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("time"),
        (F.col("a") == 0).alias("is_coinbase"),
        F.col("a").cast("int").alias("n_in"),
        F.col("b").cast("int").alias("n_out"),
    )
    return Ledger(tx, _lines(ins).withColumnRenamed("i", "in_index"), _lines(outs).withColumnRenamed("i", "n"), _orders(spark, sf_dir))


def ordered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, a, b): the lines of an order that are inputs and outputs, as arrays of (l_partkey, ..., sats) in order.

    Lines move once, as numbers; they are dealt before they are gathered, so that what moves isn't arrays.
    """
    lines = _table(spark, sf_dir, "lineitem").where("l_returnflag IN ('A', 'N', 'R')")
    moved = lines.select(F.col("l_orderkey").alias("key"), F.col("l_returnflag") == "A", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", _sats().alias("sats")).toDF("key", "spent", *LINE)
    one, spent = F.struct(*LINE), F.col("spent")
    return moved.repartition("key").groupBy("key").agg(F.sort_array(F.collect_list(F.when(spent, one))).alias("a"), F.sort_array(F.collect_list(F.when(~spent, one))).alias("b"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole transactions (ledger.whole) of the ledger view; an order's key is the transaction's."""
    tx = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_orderdate").join(ordered_lines(spark, sf_dir).hint("merge"), "key", "left")

    def side(column: str, place: str) -> Column:
        rows = F.transform(column, lambda x, i: F.struct(i.alias(place), _address(x["l_partkey"]).alias("address"), _type(x["l_partkey"]).alias("type"), x["sats"].alias("sats")))
        return F.coalesce(rows, F.array().cast(f"array<struct<{place}:int,address:string,type:string,sats:bigint>>"))

    n = lambda column: F.when(F.col(column).isNull(), 0).otherwise(F.size(column))
    return tx.select(
        "key",
        _txid(F.col("key")).alias("txid"),
        _days("o_orderdate").alias("height"),
        F.col("key").alias("tx_index"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("time"),
        (n("a") == 0).alias("is_coinbase"),
        n("a").alias("n_in"),
        n("b").alias("n_out"),
        side("a", "in_index").alias("ins"),
        side("b", "n").alias("outs"),
    )


def with_script(rows: DataFrame, key: str) -> DataFrame:
    """Add script: one of every class, in turn, from a hash of the part's key. Hash and script are computed once a row."""
    h = F.col("part_hash")
    short = F.substring(h, 1, 40)
    text = [
        F.concat(F.lit("76a914"), short, F.lit("88ac")),
        F.concat(F.lit("a914"), short, F.lit("87")),
        F.concat(F.lit("0014"), short),
        F.concat(F.lit("0020"), h),
        F.concat(F.lit("5120"), h),
        F.concat(F.lit("2102"), h, F.lit("ac")),
        F.concat(F.lit("512102"), h, F.lit("2103"), h, F.lit("52ae")),
        F.lit("51024e73"),
        F.concat(F.lit("6a20"), h),
        F.concat(F.lit("5214"), short),
        F.concat(F.lit("ff"), F.substring(h, 1, 10)),
    ]
    hashed = rows.withColumn("part_hash", once(F.sha2(F.concat(F.lit("s"), F.col(key).cast("string")), 256)))
    return hashed.withColumn("script", once(F.element_at(F.array(*text), (F.col(key) % 11 + 1).cast("int")))).drop("part_hash")


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(address, script) of every part."""
    parts = with_script(_table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    return parts.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("address"), "script")


def utxo(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice", "l_linestatus")
    return with_script(lines, "l_partkey").select(
        _days("l_shipdate").alias("height"),
        (F.col("l_linestatus") == "F").alias("coinbase"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("sats"),
        "script",
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("address"),
    )


def seeds(spark: SparkSession, sf_dir: str, every: int = 97) -> DataFrame:
    """(address, sdn_ref, sdn_name) of every ``every``-th part."""
    parts = _table(spark, sf_dir, "part").where(F.col("p_partkey") % every == 0)
    return parts.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("address"), F.col("p_brand").alias("sdn_ref"), F.col("p_type").alias("sdn_name"))


def revealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key_hash) of the parts that spend."""
    keys = with_script(_table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select("l_partkey").distinct(), "l_partkey")
    typed = keys.withColumn("kind", once(script_type(F.col("script"))))
    return typed.select(key_hash(F.col("script"), F.col("kind")).alias("key_hash")).where("key_hash IS NOT NULL")
