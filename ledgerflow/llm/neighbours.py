"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected onto a few random directions, cut into cells (at quantiles that each curve shifts), and ordered
along a Hilbert curve; CURVES such orderings are range-partitioned by Spark, as keys and ids only. A query's candidates
are the rows within a window of its place in every ordering; they are merged and reranked by exact distance on the
original vectors.

The window is measured: for a few queries the true nearest are found by comparing them with all rows, and the window is
the distance along the best curve within which RECALL of them lie. Where vectors cluster it stays small as rows are
added; where they have no structure it is a share of the rows, and the work of 1% of the rows as queries is quadratic, as
that of brute force is.

Equal vectors are one row of the index, which keeps their few smallest ids: more can't be among a query's nearest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ledgerflow.session import keep, materialize, measured, scratch

CURVES, DIRECTIONS, BITS = 8, 6, 4
#: Queries that the window is measured on, and the share of their true neighbours that it must hold.
PROBES, RECALL = 128, 0.96
#: Rows on each side of a query's place, at least, and rows that a task compares at a time, at most.
LEAST_WINDOW, BLOCK = 256, 1 << 14
#: Queries that meet a block in one task; more are dealt over several.
ASKING = 1 << 14
#: The index's quantiles are fitted on at most so many vectors; every vector is indexed.
SAMPLE = 4096
#: A hot vector's ids are ranked in so many parts first.
SALTS = 256


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of (rows, dimensions) cells along the Hilbert curve (Skilling's transposed form, 2004)."""
    axes = [c.astype(np.int64) for c in cells.T]
    n = len(axes)
    for level in range(bits - 1, 0, -1):
        top, low = 1 << level, (1 << level) - 1
        for i in range(n):
            flip = (axes[i] & top) != 0
            swap = np.where(flip, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = axes[0] ^ swap ^ np.where(flip, low, 0)
            if i:
                axes[i] = axes[i] ^ swap
    for i in range(1, n):
        axes[i] = axes[i] ^ axes[i - 1]
    mend = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        mend = np.where((axes[-1] & (1 << level)) != 0, mend ^ ((1 << level) - 1), mend)
    key = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for a in axes:
            key = key << 1 | ((a ^ mend) >> level & 1)
    return key


@dataclass(frozen=True)
class Curves:
    """Directions (curves, dimension, DIRECTIONS) and cuts (curves, DIRECTIONS, 2^BITS - 1)."""

    directions: np.ndarray
    cuts: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, dimension: int, curves: int) -> Curves:
        rng = np.random.default_rng(11)
        k = min(DIRECTIONS, dimension)
        directions = np.array([np.linalg.qr(rng.normal(size=(dimension, k)))[0] for _ in range(curves)])
        levels = (np.arange(1, 1 << BITS)[None, :] + rng.uniform(-0.5, 0.5, (curves, 1))) / (1 << BITS)
        cuts = np.array([np.quantile(sample @ d, q, axis=0).T for d, q in zip(directions, levels, strict=True)])
        return cls(directions, cuts)

    def keys(self, x: np.ndarray) -> list[np.ndarray]:
        """For every curve, the rows' places along it."""
        found = []
        for d, cut in zip(self.directions, self.cuts, strict=True):
            y = x @ d
            found.append(hilbert_keys(np.column_stack([np.searchsorted(cut[i], y[:, i]) for i in range(y.shape[1])]), BITS))
        return found


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): finite, non-zero vectors of the most frequent length; one row per id. Floats stay floats, others become doubles."""
    kind = "float" if isinstance(getattr(vectors.schema[vector_col].dataType, "elementType", None), FloatType) else "double"
    v = F.col(vector_col).cast(f"array<{kind}>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("v") == (lengths["d"] if lengths else 0))
    # + 0 makes -0 equal to 0
    return rows.groupBy("id").agg(F.min(F.transform("v", lambda x: x + F.lit(0.0).cast(kind))).alias("v"))


def _best(a: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every row of a, places in b and distances of its k nearest rows, ties to the smaller id."""
    norms = (b * b).sum(axis=1)
    slack = 1e-9 * (1 + norms.max())
    for i in range(0, len(a), 512):
        rough = norms[None, :] - 2 * (a[i : i + 512] @ b.T)
        last = min(k, len(b)) - 1
        limit = np.partition(rough, last, axis=1)[:, last]
        for j, own in enumerate(a[i : i + 512]):
            near = np.flatnonzero(rough[j] <= limit[j] + slack)
            d = np.sqrt(((b[near] - own) ** 2).sum(axis=1))
            best = np.lexsort((ids[near], d))[:k]
            yield near[best], d[best]


def exact(base: DataFrame, asked: list[int], asking: np.ndarray, k: int) -> DataFrame:
    """(cid, near, d): the k nearest rows of (cid, v) to each of a few vectors, by comparing it with every row."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                b, ids = _matrix(batch.column("v")), batch.column("cid").to_numpy()
                found = list(_best(asking, b, ids, k))
                sizes = [len(d) for _, d in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(asked, np.int64), sizes)), pa.array(ids[np.concatenate([n for n, _ in found])]), pa.array(np.concatenate([d for _, d in found]))], names=["cid", "near", "d"])

    met = base.select("cid", "v").mapInArrow(compared, "cid long, near long, d double")
    return met.withColumn("n", F.row_number().over(Window.partitionBy("cid").orderBy("d", "near"))).where(F.col("n") <= k).drop("n")


def _window(base: DataFrame, placed: DataFrame, asked: DataFrame, k: int) -> int:
    """The distance along the best curve within which RECALL of the true neighbours of PROBES queries lie."""
    probes = asked.orderBy(F.xxhash64("cid", F.lit("probe"))).limit(PROBES).toArrow()
    ids = probes["cid"].to_pylist()
    found = exact(base, ids, _matrix(probes["v"].combine_chunks()), k + 1).where("cid <> near").select("cid", "near").toPandas()
    if not len(found):
        return LEAST_WINDOW
    named = placed.sparkSession.createDataFrame([(int(i),) for i in {*ids, *found["near"]}], "cid long")  # PROBES * (k + 2) ids at most
    at = placed.join(F.broadcast(named), "cid").select("cid", "curve", "place").toPandas().set_index(["curve", "cid"])["place"]
    best = np.full(len(found), np.iinfo(np.int64).max)
    for curve in at.index.unique(0):
        places = at[curve]
        best = np.minimum(best, np.abs(places[found["near"]].to_numpy() - places[found["cid"]].to_numpy()))
    return max(LEAST_WINDOW, int(np.quantile(best, RECALL)))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, curves: int = CURVES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``, by Euclidean distance.

    Ties go to the smaller id. Defined results: vectors that are null, zero, or hold null or non-finite components take
    no part, nor do null ids and vectors whose length isn't the most frequent one; rows that share an id count as one,
    with the smallest of their vectors; equal vectors are neighbours at distance 0; with fewer candidates than k, all
    are returned; an empty table, or one without queries, gives none.
    """
    with scratch():
        return _nearest(vectors, k, every, curves, id_col, vector_col)


def _nearest(vectors: DataFrame, k: int, every: int, curves: int, id_col: str, vector_col: str) -> DataFrame:
    rows = materialize(usable(vectors, id_col, vector_col), "ann-rows")
    own = Window.partitionBy("v", "salt").orderBy("id")
    few = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("n", F.row_number().over(own)).where(F.col("n") <= k + 1)
    classes = few.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids")).withColumn("cid", F.col("ids")[0])
    classes, seen = measured(classes, "ann-classes", n="count(*)")
    total = seen["n"]
    queries, seen = measured(rows.where(F.col("id") % every == 0).join(classes.select("v", "cid"), "v").select(F.col("id").alias("query_id"), "cid"), "ann-queries", n="count(*)")
    if not seen["n"]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base, asks = classes.select("cid", "v"), seen["n"]
    asked = base.join(queries.select("cid").distinct(), "cid", "left_semi")
    place = F.xxhash64("cid", F.lit("ann"))
    sample = _matrix(base.select("v", place.alias("p")).orderBy("p").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks())
    index = Curves.fit(sample, sample.shape[1], curves)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for c, key in enumerate(index.keys(_matrix(batch.column("v")))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, c, np.int32)), pa.array(key), batch.column("cid")], names=["curve", "key", "cid"])

    parts = max(8, math.ceil(total * curves / (1 << 20)))
    ordered = base.mapInArrow(keyed, "curve int, key long, cid long").repartitionByRange(parts, "curve", "key", "cid").sortWithinPartitions("curve", "key", "cid")
    ordered = materialize(ordered.select("cid", "curve", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "ann-ordered")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the ordering, each of a million rows
    starts = materialize(ordered.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")), "ann-starts")
    placed = ordered.join(F.broadcast(starts), "part").select("cid", "curve", (F.col("start") + F.col("at")).alias("place"))
    window = _window(base, placed, asked, k)
    size = min(BLOCK, max(LEAST_WINDOW, window))
    deals = max(1, math.ceil(asks * (2 * window + size) / max(total, 1) / ASKING))
    block = lambda c: F.floor(c / size)
    stored = placed.join(base.hint("merge"), "cid").select(block(F.col("place")).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"), F.col("cid").alias("near"), F.col("v").alias("w"))
    reach = F.sequence(block(F.greatest(F.col("place") - window, F.lit(0))), block(F.col("place") + window))
    asking = placed.join(asked.hint("merge"), "cid").select("cid", "v", F.explode(reach).alias("block"), F.pmod(F.xxhash64("cid"), F.lit(deals)).cast("int").alias("deal"))

    def compared(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"cid": np.empty(0, np.int64), "near": np.empty(0, np.int64), "d": np.empty(0)})
        x, q = x.drop_duplicates("near"), q.drop_duplicates("cid")
        a, b = (np.stack(c.to_numpy()).astype(np.float64) for c in (q["v"], x["w"]))
        ids = x["near"].to_numpy()
        found = list(_best(a, b, ids, k + 1))
        sizes = [len(d) for _, d in found]
        return pd.DataFrame({"cid": np.repeat(q["cid"].to_numpy(), sizes), "near": ids[np.concatenate([n for n, _ in found])], "d": np.concatenate([d for _, d in found])})

    met = asking.groupBy("block", "deal").cogroup(stored.groupBy("block", "deal")).applyInPandas(compared, "cid long, near long, d double").distinct()
    first = Window.partitionBy("cid").orderBy("d", "near")
    top = materialize(met.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).select("cid", "near", "d"), "ann-top")
    held = top.join(classes.select(F.col("cid").alias("near"), "ids").hint("merge"), "near").groupBy("cid").agg(F.collect_list(F.struct("d", "ids")).alias("found"))
    answers = keep(queries).join(keep(materialize(held, "ann-found")), "cid")
    flat = F.expr("flatten(transform(found, f -> transform(f.ids, i -> named_struct('d', f.d, 'id', i))))")
    best = F.slice(F.array_sort(F.filter(flat, lambda f: f["id"] != F.col("query_id"))), 1, k)
    return answers.select("query_id", F.posexplode(best).alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.d").alias("score"))


def recall(found: DataFrame, vectors: DataFrame, probes: int = 200, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """The share of true nearest neighbours in ``found``, over up to ``probes`` queries that are compared with every row."""
    base = usable(vectors, id_col, vector_col).select(F.col("id").alias("cid"), "v")
    asked = base.where(F.col("cid") % every == 0).orderBy(F.xxhash64("cid", F.lit("recall"))).limit(probes).toArrow()
    if not asked.num_rows:
        return 1.0
    true = exact(base, asked["cid"].to_pylist(), _matrix(asked["v"].combine_chunks()), k + 1).where("cid <> near")
    true = true.withColumn("n", F.row_number().over(Window.partitionBy("cid").orderBy("d", "near"))).where(F.col("n") <= k).select(F.col("cid").alias("query_id"), F.col("near").alias("vec_id"))
    both = true.join(found.select("query_id", "vec_id").withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left").agg(F.count("hit"), F.count("*")).first()
    return both[0] / max(both[1], 1)


def op8(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
