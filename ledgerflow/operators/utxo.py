"""Unspent outputs by script class and age, what is dormant, and what a visible key exposes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions import scripts as S


def classified(utxo: DataFrame, bin_size: int = 1000) -> DataFrame:
    """Add script_type, key_hash and bin to (height, coinbase, sats, script)."""
    typed = utxo.withColumn("script_type", S.once(S.script_type(F.col("script"))))
    return typed.withColumn("key_hash", S.once(S.key_hash(F.col("script"), F.col("script_type")))).withColumn("bin", S.age_bin(F.col("height"), bin_size))


def by_type(coins: DataFrame) -> DataFrame:
    return coins.groupBy("script_type").agg(F.count("*").alias("coins"), F.sum("sats").alias("sats"))


def by_type_and_bin(coins: DataFrame) -> DataFrame:
    return coins.groupBy("script_type", "bin").agg(F.count("*").alias("coins"), F.sum("sats").alias("sats"))


def hash_targets(coins: DataFrame) -> DataFrame:
    """(key_hash): the distinct hashes that hash-only coins commit to."""
    return coins.where("key_hash IS NOT NULL").select("key_hash").distinct()


def with_revealed(coins: DataFrame, revealed: DataFrame) -> DataFrame:
    """Add revealed: whether the coin's hash is among (key_hash) of the revealed ones.

    Coins without a hash are dealt out by an empty key of many kinds, of a length that no hash has, so that they don't meet in one task.
    """
    known = revealed.select(F.col("key_hash").alias("known")).where("known IS NOT NULL").distinct()
    key = F.coalesce("key_hash", F.unhex(F.hex(F.pmod(F.xxhash64("height", "sats", "script"), F.lit(4096)))))
    return coins.withColumn("join_key", S.once(key)).join(known, F.col("join_key") == F.col("known"), "left").withColumn("revealed", F.col("known").isNotNull()).drop("join_key", "known")


def revealed_by_type(marked: DataFrame) -> DataFrame:
    """(script_type, coins, sats) of revealed coins, with zeros for hash-only classes that are held but not revealed."""
    hit = F.col("revealed")
    return marked.where(S.hash_only(F.col("script_type"))).groupBy("script_type").agg(F.count_if(hit).alias("coins"), F.coalesce(F.sum(F.when(hit, F.col("sats"))), F.lit(0)).alias("sats"))


def revealed_bins(marked: DataFrame) -> DataFrame:
    return marked.where("revealed").groupBy("script_type", "bin").agg(F.count("*").alias("coins"), F.sum("sats").alias("sats"))


def totals(marked: DataFrame, bin_size: int = 1000, dormant_blocks: int = 5 * 52560, measured: bool = True, tip: int | None = None) -> DataFrame:
    """One row: coins and satoshis, by visibility, dormancy, and early coinbase keys.

    The tip is the greatest height unless given. Without a reveal scan (``measured``) revealed and exposed figures are null.
    Early keys are coinbase outputs to a key; where coins say whether they are stored as a key (``compact_key``), those only.
    """
    early = (F.col("script_type") == S.P2PK) & F.col("coinbase")
    if "compact_key" in marked.columns:
        early &= F.col("compact_key")
    cells = marked.groupBy("script_type", "bin", "revealed", early.alias("early")).agg(F.count("*").alias("coins"), F.sum("sats").alias("sats"), F.max("height").alias("top"))
    # a row for each class and age bin from here on
    height = F.lit(tip).cast("int") if tip is not None else F.max("top").over(Window.partitionBy())
    cells = cells.withColumn("tip", height)
    kind, sats = F.col("script_type"), F.col("sats")
    old = S.is_dormant(F.col("bin"), F.col("tip"), bin_size, dormant_blocks)
    visible, hidden, hit = S.key_in_output(kind), S.hash_only(kind), F.col("revealed") & S.hash_only(kind)
    take = lambda c: F.coalesce(F.sum(F.when(c, sats)), F.lit(0)).cast("long")
    maybe = lambda c: c if measured else F.lit(None).cast("long")
    return cells.agg(
        F.coalesce(F.sum("coins"), F.lit(0)).alias("coins"),
        F.coalesce(F.sum("sats"), F.lit(0)).alias("sats"),
        take(visible).alias("key_in_output"),
        take(hidden).alias("hash_only"),
        take(~visible & ~hidden).alias("other"),
        maybe(take(hit)).alias("revealed"),
        maybe(take(visible | hit)).alias("exposed"),
        take(old).alias("dormant"),
        take(old & visible).alias("dormant_key_in_output"),
        maybe(take(old & (visible | hit))).alias("dormant_exposed"),
        F.coalesce(F.sum(F.when(F.col("early"), F.col("coins"))), F.lit(0)).alias("coinbase_p2pk_coins"),
        take(F.col("early")).alias("coinbase_p2pk"),
        F.max("tip").alias("tip"),
    )


def yearly_exposure(marked: DataFrame, dates: DataFrame, bin_size: int = 1000) -> DataFrame:
    """(year, key_visible, revealed, hidden, other) by the date (height, date) of each bin's first block."""
    start = dates.select((F.col("height") / bin_size).cast("int").alias("bin"), F.date_format("date", "yyyy").alias("year"), "height").where(F.col("height") % bin_size == 0).drop("height")
    kind = F.col("script_type")
    part = (
        F.when(S.key_in_output(kind), "key_visible").when(S.hash_only(kind) & F.col("revealed"), "revealed").when(S.hash_only(kind), "hidden").otherwise("other")
    )
    per_bin = marked.groupBy("bin", part.alias("part")).agg(F.sum("sats").alias("sats"))
    named = per_bin.join(start, "bin", "left").withColumn("year", F.coalesce("year", F.lit("unknown")))
    take = lambda p: F.coalesce(F.sum(F.when(F.col("part") == p, F.col("sats"))), F.lit(0)).cast("long").alias(p)
    return named.groupBy("year").agg(*[take(p) for p in ("key_visible", "revealed", "hidden", "other")])
