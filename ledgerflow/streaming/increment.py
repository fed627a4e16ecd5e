"""New blocks as a stream: extend stored tables, and keep the first spend of watched addresses and monthly flows current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.operators.ledger import Ledger, order_key
from ledgerflow.sources.decoded import BLOCK, ledger_of


def block_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of JSON block files that arrive in a folder."""
    return spark.readStream.schema(BLOCK).option("maxFilesPerTrigger", files_per_batch).json(path).where("hash IS NOT NULL")


def extend_ledger(blocks: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append each batch of blocks to the tables under ``path``; a batch that is run again replaces its own files."""

    def store(batch: DataFrame, number: int) -> None:
        found: Ledger = ledger_of(batch.dropDuplicates(["hash"]))
        for name in ("tx", "tx_in", "tx_out"):
            getattr(found, name).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    stream = blocks.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def spend_events(blocks: DataFrame, watched: DataFrame) -> DataFrame:
    """A stream of (address, txid, height, time, sats, ord): inputs of watched addresses."""
    flat = blocks.select("height", "time", F.posexplode("tx").alias("tx_index", "t")).select("height", "time", "tx_index", "t.txid", F.explode("t.vin").alias("v"))
    paid = "v.prevout.scriptPubKey.address"
    rows = flat.select("height", "tx_index", F.timestamp_seconds("time").alias("time"), "txid", F.col(paid).alias("address"), (F.col("v.prevout.value") * 100_000_000).cast("bigint").alias("sats"))
    return rows.withColumn("ord", order_key()).join(watched.select("address").distinct(), "address", "left_semi")


def spent_by_window(spends: DataFrame, width: str = "30 days", late: str = "7 days") -> DataFrame:
    """(window, address, sats, inputs) of spends, final once no block older than the watermark can come."""
    return spends.withWatermark("time", late).groupBy(F.window("time", width), "address").agg(F.sum("sats").alias("sats"), F.count("*").alias("inputs"))


def first_spend_stream(spends: DataFrame) -> DataFrame:
    """(address, first): the first spend seen so far, for update or complete mode."""
    return spends.groupBy("address").agg(F.min(F.struct("ord", "txid", "height")).alias("first"))
