"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each source gets a word budget (its target). Whole epochs of the source come first; what is left of the
budget is a weighted sample without replacement: every document draws an exponential key whose rate is its
quality weight, documents are taken in key order, and a prefix sum of their sizes stops at the budget.

The documents taken are those up to one place in the order of keys, so that each source needs that place only. It is
found by sums over ranges of keys, then over the finer ranges of the one range that holds it, and last by a prefix sum
over the few documents there. Rows themselves are neither sorted nor moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.session import keep, materialize, measured, scratch

WORDS = r"[^\x20\x09-\x0D]+"
#: Runs of two letters at least, letters beyond ASCII included: what usual words are made of.
LETTERS = r"[A-Za-z\x{80}-\x{10FFFF}]{2,}"
#: Weights dealt to the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size.
MAX_EPOCHS = 3
#: Ranges of keys per source, and finer ranges in each.
RANGES = 1 << 10
SEED = "mix-1"
P = "__mix_"


def uniform(drawn: Column, seed: str = SEED) -> Column:
    """A repeatable number in (0, 1) from what identifies a document: 52 bits of its MD5. Null counts as empty."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(drawn.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def quality_weight(text: Column, size: Column) -> Column:
    """Weight of a document, 0.1 to 1: the share of its words that are made of letters, halved where words are very short or long."""
    mean = F.char_length(text).cast("double") / size.cast("double")
    plain = F.least(F.regexp_count(text, F.lit(LETTERS)).cast("double") / size.cast("double"), F.lit(1.0))
    usual = F.when((mean >= 3.0) & (mean <= 12.0), 1.0).otherwise(0.5)
    return F.when((size == 0) | text.isNull(), 1.0).otherwise(F.greatest(plain * usual, F.lit(0.1)))


def targets(sums: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets from (source, source_size): the total shared by weight, capped at ``max_epochs`` sizes, excess reshared.

    Sharing with a cap settles at one level: a source gets min(cap, level * weight). Sorted by cap / weight, the
    capped sources come first; the level is what they leave over the weights left, at the first source that it does
    not fill (from there on such quotients fall, so it is the largest). One row per source, so the unpartitioned
    windows read as many rows as there are sources.
    """
    nth = Window.orderBy(F.col("source").asc_nulls_last())
    deal = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(nth) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sums.withColumn("weight", deal).withColumn("cap", F.col("source_size") * max_epochs)
    ratio = F.col("cap").cast("double") / F.col("weight").cast("double")
    order = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        weighed.withColumn("ratio", ratio)
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(upto), F.lit(0)))
        .withColumn("heavy", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
        .withColumn("level", F.col("left").cast("double") / F.col("heavy").cast("double"))
        .withColumn("level", F.max(F.when(F.col("level") < F.col("ratio"), F.col("level"))).over(everything))
    )
    share = F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap").cast("double"))
    return ranked.select("source", "source_size", share.otherwise(F.col("level") * F.col("weight")).alias("target"))


def _edge_range(sums: DataFrame) -> DataFrame:
    """Per source, the last range that begins within the budget: of (source, range, sum, rest, base) the row with what lies before it.

    ``base`` lies before all of them. Rows of earlier ranges fit whole, rows of later ones do not.
    """
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("before", F.col("base") + F.coalesce(F.sum("sum").over(before), F.lit(0)))
    within = placed.where("before <= rest").groupBy("source").agg(F.max(F.struct("range", "before")).alias("edge"))
    return within.select("source", F.col("edge.range").alias("range"), F.col("edge.before").alias("base"))


def _plan(rows: DataFrame, rule: dict) -> DataFrame:
    """One row per source of (source, key, drawn, size) rows: its size, target and epochs, and the place up to which rows fit.

    The place is the finer range ``fine`` and the last (key, drawn, size) in it that fits, with how many of the rows alike
    in these do (``some`` of ``alike``); null if none there does.
    """
    coarse, fine = F.floor(F.col("key") * RANGES), F.floor(F.col("key") * RANGES * RANGES)
    rows = rows.withColumn("range", F.least(coarse, F.lit(RANGES - 1)))
    sums = materialize(rows.groupBy("source", "range").agg(F.sum("size").alias("sum")), "mix-ranges")
    goals = targets(sums.groupBy("source").agg(F.sum("sum").alias("source_size")), **rule)
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    goals = materialize(goals.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-goals")
    rest = goals.select(F.col("source").alias("of"), "rest")
    same = F.col("source").eqNullSafe(F.col("of"))
    edge = materialize(_edge_range(sums.join(rest, same).drop("of").withColumn("base", F.lit(0))), "mix-edges")
    named = edge.select(F.col("source").alias("of"), F.col("range").alias("at"), "base")
    inside = rows.join(named, same & (F.col("range") == F.col("at"))).drop("of", "at").withColumn("range", fine)
    # rows alike are one row from here on
    inside = materialize(inside.groupBy("source", "range", "key", "drawn", "size").agg(F.count("*").alias("alike"), F.first("base").alias("base")), "mix-inside")
    finer = inside.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("alike")).alias("sum"), F.first("base").alias("base")).join(rest, same).drop("of")
    edge = materialize(_edge_range(finer), "mix-finer")
    named = edge.select(F.col("source").alias("of"), F.col("range").alias("at"), F.col("base").alias("start"))
    last = inside.join(named, same & (F.col("range") == F.col("at"))).drop("of", "at").join(rest, same).drop("of")
    upto = Window.partitionBy("source").orderBy("key", "drawn", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("start") + F.coalesce(F.sum(F.col("size") * F.col("alike")).over(upto), F.lit(0))
    half = F.col("size") / 2
    fit = F.when(F.col("size") > 0, F.floor((F.col("rest") - F.col("begin") - half) / F.col("size")) + 1).otherwise(F.col("alike"))
    fitting = last.withColumn("begin", start).withColumn("some", F.least(F.col("alike"), fit)).where("some > 0 AND begin <= rest")
    cut = fitting.groupBy("source").agg(F.max(F.struct("key", "drawn", "size", "some", "alike")).alias("cut"))
    cut = edge.select("source", F.col("range").alias("fine")).join(cut.withColumnRenamed("source", "of"), same, "left").drop("of")
    return goals.join(cut.withColumnRenamed("source", "of"), same, "left").drop("of", "rest")


def _numbered(rows: DataFrame, by: str) -> DataFrame:
    """Add ``number``, from 0, among rows alike in ``by``: first in each part of the written table, then across parts."""
    rows = keep(materialize(rows.withColumn(P + "part", F.spark_partition_id()).withColumn(P + "at", F.monotonically_increasing_id()), "mix-alike"))
    counts = rows.groupBy(by, P + "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(by).orderBy(P + "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(by).alias(P + "of"), F.col(P + "part").alias(P + "p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(P + "start"))
    here = F.row_number().over(Window.partitionBy(by, P + "part").orderBy(P + "at")) - 1
    joined = rows.withColumn(P + "here", here).join(starts, F.col(by).eqNullSafe(F.col(P + "of")) & (F.col(P + "part") == F.col(P + "p")))
    return joined.withColumn(P + "number", F.col(P + "start") + F.col(P + "here"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", weight_col: str = "weight", out: tuple[str, str, str] = ("source_size", "target", "taken"), **rule) -> DataFrame:
    """Add source_size, target and taken, named by ``out``, to ``docs`` (extra columns stay; those three must not exist yet).

    ``docs`` is read twice: once for (source, size, key), which is written, and once more for the result, to which only one row
    per source is joined. Defined results: null sizes count as 0; a document of size 0 takes 0; null ids count as one id;
    of rows alike in id and size as many are taken as fit, any of them; a null source is a source, the last; an empty table
    gives none. Columns of ``docs`` may not begin with ``__mix_``.
    A document at the edge of the budget is taken when at least half of it fits, so a source misses its target by
    half of its largest document at most.
    """
    # F = 1 - exp(-key) grows with the exponential key -ln(u) / weight and lies in (0, 1)
    key = F.lit(1.0) - F.pow(uniform(F.col(id_col)), F.lit(1.0) / F.coalesce(F.col(weight_col), F.lit(1.0)))
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    drawn, source = F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(source_col)
    with scratch():
        rows = materialize(docs.select(source.alias("source"), key.alias("key"), drawn.alias("drawn"), size.alias("size")), "mix-rows")
        plan = _plan(rows, rule).select(*[F.col(c).alias(P + c) for c in ("source", "source_size", "target", "epochs", "fine", "cut")])
        plan, seen = measured(plan, "mix-plan", split=f"count_if({P}cut.some < {P}cut.alike)")
        keep(plan)
        wide = docs.withColumns({P + "key": key, P + "drawn": drawn, P + "size": size})
        wide = wide.join(plan, source.eqNullSafe(F.col(P + "source")), "left")
        place, mine = F.floor(F.col(P + "key") * RANGES * RANGES), F.struct(*[F.col(P + c).alias(c) for c in ("key", "drawn", "size")])
        at = F.struct(*[F.col(f"{P}cut.{c}").alias(c) for c in ("key", "drawn", "size")])
        known = (place == F.col(P + "fine")) & F.col(P + "cut").isNotNull()
        wide = wide.withColumn(P + "edge", F.coalesce(known & (mine == at) & F.expr(f"{P}cut.some < {P}cut.alike"), F.lit(False)))
        fits = F.coalesce((place < F.col(P + "fine")) | (known & (mine <= at)), F.lit(False))
        if seen["split"]:  # of rows alike at the edge, some are taken
            edge = _numbered(wide.where(P + "edge"), P + "source").withColumn(P + "fits", F.col(P + "number") < F.col(P + "cut.some"))
            wide = wide.where(f"NOT {P}edge").withColumn(P + "fits", fits)
            wide = wide.unionByName(edge.select(*wide.columns))
        else:
            wide = wide.withColumn(P + "fits", fits)
    taken = F.coalesce(F.col(P + "epochs"), F.lit(0)) * F.col(P + "size") + F.when(F.col(P + "fits"), F.col(P + "size")).otherwise(F.lit(0))
    named = zip((F.col(P + "source_size"), F.col(P + "target"), taken.cast("long")), out, strict=True)
    return wide.select(*docs.columns, *[c.alias(name) for c, name in named])


def drawn_by(id_col: Column, text: Column) -> Column:
    """What identifies a document for its draw: the id, or the text where the id is null."""
    return F.coalesce(id_col.cast("string"), F.md5(text.cast("binary")), F.lit(""))


def sized(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The columns mix() needs from documents: ids, source, size in words, quality weight, and what is drawn by."""
    counted = docs.select(*keep, "text", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))
    return counted.select(*keep, "size", quality_weight(F.col("text"), F.col("size")).alias("weight"), drawn_by(F.col("doc_id"), F.col("text")).alias("drawn"))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = materialize(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")), "mix-sized")
    return mix(docs, id_col="drawn").select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = rf"""
WITH c AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) AS BIGINT) AS size, length(text) AS chars,
         len(regexp_extract_all(text, '{LETTERS}')) AS letters, coalesce(CAST(doc_id AS VARCHAR), md5(text), '') AS drawn
  FROM documents),
w AS (
  SELECT *, (CAST(CAST('0x' || substr(md5('{SEED}:' || drawn), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / {float(1 << 52)} AS u,
    CASE WHEN size = 0 OR chars IS NULL THEN 1.0::DOUBLE ELSE greatest(least(letters::DOUBLE / size::DOUBLE, 1.0::DOUBLE)
      * CASE WHEN chars::DOUBLE / size::DOUBLE BETWEEN 3.0 AND 12.0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END, 0.1::DOUBLE) END AS q
  FROM c),
k AS (SELECT *, 1.0::DOUBLE - pow(u, 1.0::DOUBLE / q) AS key FROM w),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
g AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM s),
r AS (SELECT *, cap::DOUBLE / weight::DOUBLE AS ratio FROM g),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS lev
  FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, max(CASE WHEN lev < ratio THEN lev END) OVER () AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR ratio <= level THEN cap::DOUBLE ELSE level * weight END AS target FROM m),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t)
SELECT k.doc_id, k.size, e.source_size, e.target,
  CAST(e.epochs * k.size + CASE WHEN coalesce(sum(k.size) OVER p, 0) + k.size / 2 <= e.target - e.epochs * e.source_size THEN k.size ELSE 0 END AS BIGINT) AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
WINDOW p AS (PARTITION BY k.source ORDER BY k.key, k.drawn, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
"""
