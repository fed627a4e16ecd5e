"""Whether what listed addresses hold sits behind a key that can already be seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions import scripts as S
from ledgerflow.operators.ledger import Ledger, order_key

NO_BALANCE, VISIBLE, SPENT_BEFORE, HIDDEN, NOT_APPLICABLE = "no balance", "key in output", "spent before", "hash only", "not applicable"


def balances(addresses: DataFrame, utxo: DataFrame) -> DataFrame:
    """(address, script, script_type, sats, utxos, oldest_height) of (address, script); addresses without coins have zeros.

    Coins are matched by script; two addresses with one script both get them.
    """
    asked = addresses.select("address", "script").distinct()
    held = utxo.join(asked.select("script").distinct(), "script", "left_semi").groupBy("script").agg(F.sum("sats").alias("sats"), F.count("*").alias("utxos"), F.min("height").alias("oldest_height"))
    return asked.join(held, "script", "left").fillna(0, ["sats", "utxos"]).withColumn("script_type", S.once(S.script_type(F.col("script"))))


def first_spends(ledger: Ledger, addresses: DataFrame) -> DataFrame:
    """(address, first_height, first_time, first_txid): the first transaction, in block order, that spends from each address."""
    spent = ledger.tx_in.join(addresses.select("address").distinct(), "address", "left_semi").select("address", "txid").distinct()
    placed = spent.join(ledger.tx.select("txid", "height", "time", "tx_index"), "txid").withColumn("ord", order_key())
    first = placed.groupBy("address").agg(F.min(F.struct("ord", "txid", "height", "time")).alias("x"))
    return first.select("address", F.col("x.height").alias("first_height"), F.col("x.time").alias("first_time"), F.col("x.txid").alias("first_txid"))


def exposure(addresses: DataFrame, utxo: DataFrame, ledger: Ledger, seed_info: DataFrame | None = None) -> DataFrame:
    """One row per address: balance, status and, for funded hash-only addresses, the first spend."""
    rows = balances(addresses, utxo)
    funded, hidden = F.col("sats") > 0, S.hash_only(F.col("script_type"))
    spends = first_spends(ledger, rows.where(funded & hidden))
    rows = rows.join(spends, "address", "left")
    status = (
        F.when(~funded, NO_BALANCE)
        .when(S.key_in_output(F.col("script_type")), VISIBLE)
        .when(hidden & F.col("first_txid").isNotNull(), SPENT_BEFORE)
        .when(hidden, HIDDEN)
        .otherwise(NOT_APPLICABLE)
    )
    rows = rows.withColumn("status", status).withColumn("exposed", F.col("status").isin(VISIBLE, SPENT_BEFORE))
    if seed_info is None:
        return rows.withColumn("sdn_ref", F.lit(None).cast("string")).withColumn("sdn_name", F.lit(None).cast("string"))
    return rows.join(seed_info.select("address", "sdn_ref", "sdn_name"), "address", "left")


def _sums(rows) -> DataFrame:
    take = lambda c: F.coalesce(F.sum(F.when(c, F.col("sats"))), F.lit(0)).cast("long")
    return rows.agg(
        F.count("*").alias("addresses"),
        F.count_if(F.col("sats") > 0).alias("funded_addresses"),
        F.count_if("exposed").alias("exposed_addresses"),
        F.coalesce(F.sum("sats"), F.lit(0)).alias("balance"),
        take(F.col("exposed")).alias("exposed"),
        take(F.col("status") == HIDDEN).alias("hash_only"),
    )


def exposure_totals(rows: DataFrame) -> DataFrame:
    return _sums(rows.groupBy())


def exposure_by_type(rows: DataFrame) -> DataFrame:
    return _sums(rows.groupBy("script_type"))


def exposure_by_entry(rows: DataFrame) -> DataFrame:
    """Totals per listed entry, the largest balance first."""
    listed = rows.where("sdn_ref IS NOT NULL")
    names = listed.groupBy("sdn_ref").agg(F.min("sdn_name").alias("sdn_name"))
    return _sums(listed.groupBy("sdn_ref")).join(names, "sdn_ref").orderBy(F.desc("balance"), "sdn_ref")
