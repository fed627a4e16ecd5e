"""Connected components over an edge table of any size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.session import keep, materialize, measured, scratch

#: Each round at least halves the depth of the trees, so this many rounds cover any table.
MAX_ROUNDS = 64
#: Up to so many edges, which is counted first, one task joins them in its memory: some 20 MB.
FEW = 1 << 17


def _large_star(edges: DataFrame, n: int) -> tuple[DataFrame, int, bool]:
    """Every node tells its larger neighbours the smallest node it knows: (edges, their number, whether they changed).

    Nothing changes if the lower end of every edge knows no smaller node than itself; that is seen before the join.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    knows = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("above")).select("u", F.least("u", "m").alias("m"), "above")
    least, seen = measured(knows, "cc-large", still="sum(CASE WHEN m = u THEN above END)")
    if seen["still"] == n:
        return edges, n, False
    told = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least.select("u", "m").hint("merge"), "u")
    out, seen = measured(told.select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc-round", n="count(*)")
    return out, seen["n"], True


def _small_star(edges: DataFrame, n: int) -> tuple[DataFrame, int, bool]:
    """Every node tells its smaller neighbours, and itself, the smallest of them. Expects u > v; as _large_star().

    Nothing changes if every node has one smaller neighbour.
    """
    least, seen = measured(edges.groupBy("u").agg(F.min("v").alias("m")), "cc-small", n="count(*)")
    if seen["n"] == n:
        return edges, n, False
    told = edges.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out, seen = measured(told.union(least.select("u", F.col("m").alias("v"))).distinct(), "cc-round", n="count(*)")
    return out, seen["n"], True


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all the edges of one task, by parents: (node, component)."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    kinds = [pa.null(), pa.null()]
    for batch in batches:
        kinds = batch.schema.types
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kinds[0]), pa.array([root(x) for x in nodes], kinds[1])], names=["node", "component"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", few: int = FEW) -> DataFrame:
    """Label each node of ``edges`` with the smallest node of its component: (node, component).

    Alternating large-star and small-star steps (Kiveris et al., 2014) until neither changes anything. Every step is
    written to shared storage; only counts, taken by the jobs that write, reach the driver. Joins against the per-node
    minimum read two written tables, so a hub with many edges is split by adaptive execution. Self-loops label a node
    with itself; edges with a null end are ignored; an empty table gives an empty result.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    with scratch():
        directed = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        every, seen = measured(directed, "cc-edges", n="count(*)", loops="count_if(u = v)")
        if seen["n"] <= few:
            kind = every.schema["u"].dataType.simpleString()
            return keep(materialize(every.coalesce(1).mapInArrow(_joined, f"node {kind}, component {kind}"), "cc-few"))
        loops, work, n = every.where("u = v").select("u"), every.where("u <> v"), seen["n"] - seen["loops"]
        work.stored_at = every.stored_at
        for _ in range(MAX_ROUNDS if n else 0):
            work, n, moved = _large_star(work, n)
            work, n, merged = _small_star(work, n)
            if not moved and not merged:
                break
        else:
            if n:
                raise RuntimeError("connected components did not settle")
        found = work.select(F.col("u").alias("node"), F.col("v").alias("component"))
        labelled = found.union(work.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        keep(work if n else every)
        if seen["loops"]:
            keep(every)
            alone = loops.select(F.col("u").alias("node")).join(labelled.select("node").hint("merge"), "node", "left_anti")
            labelled = labelled.union(alone.select("node", F.col("node").alias("component")))
        return labelled
