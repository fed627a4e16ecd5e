"""Decoded blocks (JSON) to ledger tables, and incremental arrival of more of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.operators.ledger import Ledger

SCRIPT = "struct<address:string,type:string>"
BLOCK = (
    "hash string, height int, time bigint, tx array<struct<txid:string,"
    f"vin:array<struct<txid:string,vout:int,coinbase:string,prevout:struct<value:decimal(16,8),scriptPubKey:{SCRIPT}>>>,"
    f"vout:array<struct<n:int,value:decimal(16,8),scriptPubKey:{SCRIPT}>>>>"
)


def _sats(value):
    return F.coalesce((value * F.lit(100_000_000)).cast("bigint"), F.lit(0).cast("bigint"))


def _is_coinbase(t: Column) -> Column:
    return F.exists(t["vin"], lambda v: v["coinbase"].isNotNull())


def without_coinbases(blocks: DataFrame) -> DataFrame:
    """Blocks without their coinbase transactions, which a block tells by itself; places in the block close up."""
    return blocks.withColumn("tx", F.filter("tx", lambda t: ~_is_coinbase(t)))


def ledger_of(blocks: DataFrame) -> Ledger:
    """Tables of BLOCK rows. A transaction is a coinbase if any input says so; inputs without an address keep their row."""
    flat = blocks.select("height", "time", F.posexplode("tx").alias("tx_index", "t"))
    tx = flat.select(
        "t.txid",
        "height",
        "tx_index",
        "time",
        _is_coinbase(F.col("t")).alias("is_coinbase"),
        F.size("t.vin").alias("n_in"),
        F.size("t.vout").alias("n_out"),
    )
    ins = flat.select("t.txid", F.posexplode("t.vin").alias("in_index", "v"))
    outs = flat.select("t.txid", F.explode("t.vout").alias("v"))
    paid = "v.prevout.scriptPubKey"
    tx_in = ins.select("txid", "in_index", F.col(f"{paid}.address").alias("address"), F.col(f"{paid}.type").alias("type"), _sats(F.col("v.prevout.value")).alias("sats"))
    tx_out = outs.select("txid", F.col("v.n").alias("n"), F.col("v.scriptPubKey.address").alias("address"), F.col("v.scriptPubKey.type").alias("type"), _sats(F.col("v.value")).alias("sats"))
    return Ledger(tx, tx_in, tx_out)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks from JSON lines; a line that was cut off is left out."""
    rows = spark.read.schema(BLOCK + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.where("hash IS NOT NULL AND tx IS NOT NULL").drop("_corrupt_record")


def write_ledger(ledger: Ledger, path: str, height_range: int = 1000) -> None:
    """Store the tables as Parquet; transactions are partitioned by height range, so that scans from a height prune."""
    ledger.tx.withColumn("height_range", F.floor(F.col("height") / height_range).cast("int")).write.mode("overwrite").partitionBy("height_range").parquet(f"{path}/tx")
    ledger.tx_in.write.mode("overwrite").parquet(f"{path}/tx_in")
    ledger.tx_out.write.mode("overwrite").parquet(f"{path}/tx_out")


def read_ledger(spark: SparkSession, path: str) -> Ledger:
    return Ledger(spark.read.parquet(f"{path}/tx").drop("height_range"), spark.read.parquet(f"{path}/tx_in"), spark.read.parquet(f"{path}/tx_out"))
