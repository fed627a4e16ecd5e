"""How much value left a cluster or a listed entity: a low figure by whole clusters, a high one without batch sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.scripts import month_of
from ledgerflow.operators.trace import Trace
from ledgerflow.session import materialize

MEASURES = ("to_outside_addresses", "to_outside_addresses_core", "to_other_seed_clusters", "into_service_sweeps", "into_service_sweeps_core", "into_coinjoins")


def _placed(rows: DataFrame, column: str, full: DataFrame, core: DataFrame, prefix: str) -> DataFrame:
    """Add the full and core component of an address column."""
    f = full.select(F.col("address").alias(column), F.col("full").alias(prefix + "_full"))
    c = core.select(F.col("address").alias(column), F.col("core").alias(prefix + "_core"))
    return rows.join(f.hint("merge"), column, "left").join(c.hint("merge"), column, "left")


def _same(view: str, a: str = "src", b: str = "dst") -> Column:
    """Whether two addresses are one, or in one component of the view."""
    return (F.col(a) == F.col(b)) | F.coalesce(F.col(f"{a}_{view}") == F.col(f"{b}_{view}"), F.lit(False))


def flows(found: Trace, full: DataFrame, core: DataFrame) -> DataFrame:
    """One row per hop, per destination of a sweep, and per mix, with the components of both ends.

    (kind, txid, date, sats, src, dst, src_full, src_core, dst_full, dst_core): src is the first spender, who is credited.
    """
    one = F.col("spenders")[0].alias("src")
    hops = found.hops.select(F.lit("hop").alias("kind"), "txid", "date", "sats", one, F.col("address").alias("dst"), F.col("spenders"))
    sweeps = found.service_stops.select(F.lit("sweep").alias("kind"), "txid", "date", F.col("traced_sats").alias("sats"), one, F.explode_outer("outputs.address").alias("dst"), "spenders")
    mixes = found.coinjoin_stops.select(F.lit("mix").alias("kind"), "txid", "date", F.col("traced_sats").alias("sats"), one, F.lit(None).cast("string").alias("dst"), "spenders")
    rows = hops.unionByName(sweeps).unionByName(mixes)
    return materialize(_placed(_placed(rows, "src", full, core, "src"), "dst", full, core, "dst"), "flows")


def classify_sweeps(found: Trace, full: DataFrame, core: DataFrame) -> DataFrame:
    """(txid, internal, internal_core): whether any spender shares a component with any destination."""
    pairs = found.service_stops.select("txid", F.explode("spenders").alias("src"), F.col("outputs.address").alias("to"))
    pairs = pairs.select("txid", "src", F.explode_outer("to").alias("dst"))
    placed = _placed(_placed(pairs, "src", full, core, "src"), "dst", full, core, "dst")
    known = F.col("dst").isNotNull()
    return placed.groupBy("txid").agg(F.max(known & _same("full")).alias("internal"), F.max(known & _same("core")).alias("internal_core"))


def cluster_outflow(found: Trace, clusters: DataFrame, full: DataFrame, core: DataFrame) -> DataFrame:
    """(cluster, seeds, the MEASURES in satoshis, spending_txs) of clusters credited with any spend."""
    listed = clusters.select("cluster", "full", "seeds")
    seeded = listed.where("seeds > 0").select(F.col("full").alias("dst_full"), F.lit(True).alias("dst_seeded"))
    rows = flows(found, full, core).join(listed.select("cluster", "seeds", F.col("full").alias("src_full")).hint("merge"), "src_full")
    rows = rows.join(seeded.hint("merge"), "dst_full", "left").join(classify_sweeps(found, full, core).hint("merge"), "txid", "left")
    hop, mix = F.col("kind") == "hop", F.col("kind") == "mix"
    apart, apart_core = ~_same("full"), ~_same("core")
    # a sweep has a row per destination and counts once
    once = rows.groupBy("cluster", "seeds", "txid", "kind").agg(
        *[
            F.sum(F.when(hop & c, F.col("sats")).otherwise(0)).alias(n)
            for n, c in ((MEASURES[0], apart), (MEASURES[1], apart_core), (MEASURES[2], apart & F.coalesce("dst_seeded", F.lit(False))))
        ],
        F.max(F.when((F.col("kind") == "sweep") & ~F.coalesce("internal", F.lit(False)), F.col("sats")).otherwise(0)).alias(MEASURES[3]),
        F.max(F.when((F.col("kind") == "sweep") & ~F.coalesce("internal_core", F.lit(False)), F.col("sats")).otherwise(0)).alias(MEASURES[4]),
        F.max(F.when(mix, F.col("sats")).otherwise(0)).alias(MEASURES[5]),
    )
    return once.groupBy("cluster", "seeds").agg(*[F.sum(m).cast("long").alias(m) for m in MEASURES], F.count_distinct("txid").alias("spending_txs"))


def outflow_total(outflow: DataFrame) -> DataFrame:
    """Sums of the measures over clusters with seeds, low and high totals included."""
    sums = outflow.where("seeds > 0").agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in (*MEASURES, "spending_txs")])
    low = F.col(MEASURES[0]) + F.col(MEASURES[3]) + F.col(MEASURES[5])
    high = F.col(MEASURES[1]) + F.col(MEASURES[4]) + F.col(MEASURES[5])
    return sums.withColumn("total", low).withColumn("total_core", high)


def _entity_flows(found: Trace, seed_info: DataFrame, full: DataFrame, core: DataFrame) -> DataFrame:
    """(entity, kind, txid, date, sats, low, high): once per hop, sweep and mix credited to an entity's clusters.

    Seeds without an entry form one entity, named by an empty string.
    """
    seeds = found.seeds.join(seed_info.hint("merge"), "address", "left").select("address", F.coalesce("sdn_ref", F.lit("")).alias("entity"))
    roots = seeds.join(full.hint("merge"), "address").select("entity", "full").distinct()
    cores = seeds.join(core.hint("merge"), "address").select("entity", "core").distinct()
    rows = flows(found, full, core).join(roots.select("entity", F.col("full").alias("src_full")).hint("merge"), "src_full")
    rows = rows.join(roots.select("entity", F.col("full").alias("dst_full"), F.lit(True).alias("inside")).hint("merge"), ["entity", "dst_full"], "left")
    rows = rows.join(cores.select("entity", F.col("core").alias("dst_core"), F.lit(True).alias("inside_core")).hint("merge"), ["entity", "dst_core"], "left")
    rows = rows.join(seeds.select("entity", F.col("address").alias("dst"), F.lit(True).alias("own")).hint("merge"), ["entity", "dst"], "left")
    no = F.lit(False)
    in_core = F.col("dst").isNotNull() & (F.coalesce("own", no) | _same("core") | F.coalesce("inside_core", no))
    marked = rows.withColumn("in_low", F.coalesce("inside", no)).withColumn("in_high", F.coalesce(in_core, no))
    hops = marked.where("kind = 'hop'").select("entity", "kind", "txid", "date", "sats", (~F.col("in_low")).alias("low"), (~F.col("in_high")).alias("high"))
    ends = marked.where("kind <> 'hop'").groupBy("entity", "kind", "txid", "date", "sats").agg((~F.max("in_low")).alias("low"), (~F.max("in_high")).alias("high"))
    mix = F.col("kind") == "mix"
    return hops.unionByName(ends.withColumn("low", F.col("low") | mix).withColumn("high", F.col("high") | mix))


def entity_outflow(found: Trace, seed_info: DataFrame, full: DataFrame, core: DataFrame) -> DataFrame:
    """(sdn_ref, seeds, clusters, cluster_addresses, measures, spending_txs) of every entity; transfers inside it drop out."""
    rows = _entity_flows(found, seed_info, full, core)
    take = lambda kind, side: F.coalesce(F.sum(F.when((F.col("kind") == kind) & F.col(side), F.col("sats"))), F.lit(0)).cast("long")
    sums = rows.groupBy("entity").agg(
        take("hop", "low").alias(MEASURES[0]),
        take("hop", "high").alias(MEASURES[1]),
        take("sweep", "low").alias(MEASURES[3]),
        take("sweep", "high").alias(MEASURES[4]),
        take("mix", "low").alias(MEASURES[5]),
        F.count_distinct("txid").alias("spending_txs"),
    )
    seeds = found.seeds.join(seed_info.hint("merge"), "address", "left").select("address", F.coalesce("sdn_ref", F.lit("")).alias("entity")).join(full.hint("merge"), "address", "left")
    sizes = full.groupBy("full").agg(F.count("*").alias("members"))
    counts = seeds.groupBy("entity").agg(F.count_distinct("address").alias("seeds"), F.count_distinct("full").alias("clusters"))
    held = seeds.select("entity", "full").distinct().join(sizes.hint("merge"), "full").groupBy("entity").agg(F.sum("members").alias("cluster_addresses"))
    every = counts.join(held.hint("merge"), "entity", "left").join(sums.hint("merge"), "entity", "left").fillna(0)
    return every.select(F.when(F.col("entity") != "", F.col("entity")).alias("sdn_ref"), *[c for c in every.columns if c != "entity"])


def entity_months(found: Trace, seed_info: DataFrame, full: DataFrame, core: DataFrame) -> DataFrame:
    """(sdn_ref, month, low, high) in satoshis; months with no value leaving are there with zeros."""
    rows = _entity_flows(found, seed_info, full, core).withColumn("month", month_of(F.col("date")))
    amount = lambda side: F.sum(F.when(F.col(side), F.col("sats")).otherwise(0)).cast("long").alias(side)
    return rows.groupBy("entity", "month").agg(amount("low"), amount("high")).select(F.when(F.col("entity") != "", F.col("entity")).alias("sdn_ref"), "month", "low", "high")


def top_destinations(found: Trace, k: int = 5) -> DataFrame:
    """(address, sats): where sweeps went, a sweep's value split equally over its outputs; the k largest, ties by address."""
    outs = found.service_stops.select("traced_sats", "outputs", F.explode("outputs.address").alias("address")).where("address IS NOT NULL")
    share = F.col("traced_sats") / F.size("outputs")
    return outs.groupBy("address").agg(F.sum(share).alias("sats")).orderBy(F.desc("sats"), "address").limit(k)


def label_counts(found: Trace) -> DataFrame:
    return found.hops.groupBy("label").agg(F.count("*").alias("outputs"), F.sum("sats").alias("sats"))
