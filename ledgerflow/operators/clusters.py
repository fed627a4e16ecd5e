"""Clusters of addresses from links, with and without those from large batch sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.operators.graph import connected_components
from ledgerflow.operators.ledger import Ledger, common_input_links
from ledgerflow.session import keep, materialize, measured, scratch


def common_input_clusters(ledger: Ledger) -> DataFrame:
    """(address, cluster, size): addresses spent together, the cluster named by its smallest address."""
    found = connected_components(common_input_links(ledger))
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    return found.join(sizes.hint("merge"), "component").select(F.col("node").alias("address"), F.col("component").alias("cluster"), "size")


def two_views(links: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memberships (address, full) and (address, core) from (src, dst, batch_sweep) links.

    Seeds belong to the full view even without links, but to the core view only through links. A link of an address
    with itself is evidence and joins nothing. The full view joins components of the core by batch links, of which there
    are few; without any the two are one.
    """
    with scratch():
        core = connected_components(links.where("NOT batch_sweep")).withColumnsRenamed({"node": "address", "component": "core"})
        core = keep(materialize(core, "core"))
        ends = links.where("batch_sweep").select("src", "dst").distinct()
        for end in ("src", "dst"):
            named = core.select(F.col("address").alias(end), F.col("core").alias("c"))
            ends = ends.join(named.hint("merge"), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
        ends, seen = measured(ends, "batch-links", n="count(*)")
        full = core.withColumnRenamed("core", "full")
        if seen["n"]:
            over = connected_components(ends).withColumnsRenamed({"node": "full", "component": "whole"})
            nodes = full.union(links.where("batch_sweep").select(F.explode(F.array("src", "dst")).alias("address"), F.col("address").alias("full")).join(core.hint("merge"), "address", "left_anti")).distinct()
            full = nodes.join(over.hint("merge"), "full", "left").select("address", F.coalesce("whole", "full").alias("full"))
        alone = seeds.select("address").distinct().join(full.hint("merge"), "address", "left_anti")
        full = keep(materialize(full.union(alone.select("address", F.col("address").alias("full"))), "full"))
    return full, core


def clusters(links: DataFrame, seeds: DataFrame, full: DataFrame, core: DataFrame) -> DataFrame:
    """(cluster, full, addresses, seeds, batch_links, evidence, size_without_batch_sweeps), seeded clusters first, then the largest.

    Clusters of one address without a seed are left out with their evidence. evidence counts link records (txid and kind);
    size_without_batch_sweeps is the largest core component of the seeds, or else of the members.
    """
    marked = full.join(seeds.select("address").distinct().withColumn("is_seed", F.lit(True)).hint("merge"), "address", "left").withColumn("is_seed", F.coalesce("is_seed", F.lit(False)))
    core_sizes = core.groupBy("core").agg(F.count("*").alias("core_size"))
    sized = marked.join(core.join(core_sizes.hint("merge"), "core").select("address", "core_size").hint("merge"), "address", "left").withColumn("core_size", F.coalesce("core_size", F.lit(1)))
    groups = sized.groupBy("full").agg(
        F.count("*").alias("addresses"),
        F.count_if("is_seed").alias("seeds"),
        F.coalesce(F.max(F.when(F.col("is_seed"), F.col("core_size"))), F.max("core_size")).alias("size_without_batch_sweeps"),
    )
    records = links.select("txid", "kind", "src", "batch_sweep").distinct().join(full.withColumnRenamed("address", "src").hint("merge"), "src")
    evidence = records.groupBy("full").agg(F.count("*").alias("evidence"), F.count_if("batch_sweep").alias("batch_links"))
    kept = groups.where("addresses > 1 OR seeds > 0").join(evidence.hint("merge"), "full", "left").fillna(0, ["evidence", "batch_links"])
    order = Window.orderBy((F.col("seeds") == 0), F.desc("addresses"), "full")
    return kept.select(F.row_number().over(order).alias("cluster"), "full", "addresses", "seeds", "batch_links", "evidence", "size_without_batch_sweeps")
