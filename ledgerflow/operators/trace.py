"""Following value forward from seed addresses, level by level.

A level's transactions are ordered, and an address reached by one is known to those after it; whether a later
transaction sweeps many strangers' coins depends on that. The dependency only points backwards, so the level has one
solution, found by repeating set operations until the set of branch-ending sweeps is stable.

A level reads of the ledger who spends from the frontier and who pays to it, as keys and addresses, and once the
transactions that spend, whole. These are written, a row each; what a transaction says by itself is computed in its row, and
only addresses meet in joins. These are sort-merge joins: tables of addresses have no bound that a broadcast could rely on.
With ``resume`` the tables of a finished level go to a folder that a later run of the same trace, or of a deeper one, takes
them from.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.scripts import to_day
from ledgerflow.operators.ledger import CHANGE, Ledger, heights, labelled, order_key, paid, spend_order, whole, with_change, with_mix
from ledgerflow.session import keep, materialize, measured, scratch

SAMPLE = 10


@dataclass
class Trace:
    """What a trace found, as tables; ``truncated`` says that the cap on addresses refused one."""

    seeds: DataFrame
    parameters: dict
    tip: int
    levels: list[dict] = field(default_factory=list)
    transactions: DataFrame | None = None
    hops: DataFrame | None = None
    coinjoin_stops: DataFrame | None = None
    service_stops: DataFrame | None = None
    links: DataFrame | None = None
    activity: DataFrame | None = None
    unexplored: DataFrame | None = None
    truncated: bool = False


def _reaches(ledger: Ledger, frontier: DataFrame) -> DataFrame:
    """(key, spenders, reached, traced_sats) of transactions with inputs of (address, reached): the earliest reach, and what these inputs hold."""
    hit = paid(ledger, "ins").join(frontier.hint("merge"), "address")
    return hit.groupBy("key").agg(F.array_sort(F.collect_set("address")).alias("spenders"), F.min("reached").alias("reached"), F.coalesce(F.sum("sats"), F.lit(0)).alias("traced_sats"))


def spends_of(ledger: Ledger, frontier: DataFrame) -> DataFrame:
    """(txid, spenders, reached): transactions spending from (address, reached), none from before the address was reached.

    A transaction counts from the earliest reach among the spenders that it has.
    """
    hit = ledger.tx_in.select("txid", "address").join(frontier, "address")
    by_tx = hit.groupBy("txid").agg(F.array_sort(F.collect_set("address")).alias("spenders"), F.min("reached").alias("reached"))
    return ledger.tx.select("txid", "height", "tx_index", "time", "is_coinbase", "n_in", "n_out").join(by_tx, "txid").where("height >= reached").withColumn("ord", order_key())


def blocks_touching(ledger: Ledger, frontier: DataFrame, start: int, spent: DataFrame | None = None) -> int:
    """Blocks from ``start`` on with a transaction that receives at, or spends from, the frontier; ``spent`` (key) are those that spend, if known."""
    hit = lambda side: paid(ledger, side).select("key", "address").join(frontier.select("address").hint("merge"), "address", "left_semi").select("key")
    touched = hit("outs").union(hit("ins") if spent is None else spent.select("key"))
    return heights(ledger).where(F.col("height") >= start).join(touched.hint("merge"), "key", "left_semi").select("height").distinct().count()


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


#: Tables of a finished level that later levels and the result are made of.
LEVEL = ("info", "followed")


def trace(
    ledger: Ledger, seeds: DataFrame, max_depth: int = 2, max_addresses: int | None = 100, min_sats: int = 0, start_height: int = 0, service_min_inputs: int = 20, round_unit: int = 100_000, resume: str | None = None
) -> Trace:
    """Follow funds from ``seeds`` (address) for ``max_depth`` levels.

    A transaction whose distinct input addresses hold ``service_min_inputs`` or more that the trace doesn't know is a
    sweep: with at most two outputs it ends the branch, with more it is followed and its links are marked; 0 turns both
    off. Mixes end the branch as well. Outputs of at least ``min_sats`` to addresses not yet known are followed until
    ``max_addresses`` are known (None: no cap), in the order of transactions and outputs. ``resume`` names a folder of
    finished levels; they are those of the same seeds, parameters and tip.
    """
    rule = {"max_addresses": max_addresses, "min_sats": min_sats, "start_height": start_height, "service_min_inputs": service_min_inputs}
    with scratch():
        seeds, seen = measured(seeds.select("address").where("address IS NOT NULL").distinct(), "trace-seeds", n="count(*)", h="sum(xxhash64(address) & 1099511627775)")
        out = Trace(keep(seeds), {"max_depth": max_depth} | rule, ledger.tip())
        folder = f"{resume}/{_name({**rule, 'round_unit': round_unit, 'tip': out.tip, 'seeds': [seen['n'], seen['h']]})}" if resume else None
        frontier, low, known = seeds.withColumn("reached", F.lit(start_height).cast("int")), start_height, [seeds]
        reached, count, levels = seen["n"], seen["n"], []
        for depth in range(1, max_depth + 1):
            if not reached:
                break
            level = _stored_level(seeds.sparkSession, folder, depth)
            if level is None:
                level = _level(ledger, frontier, levels, _union(known), count, low, depth, max_addresses, min_sats, service_min_inputs, round_unit)
                level["stats"] = {"depth": depth, "addresses": reached, "scanned_from_height": low} | level["stats"]
                _store_level(level, folder, depth)
            levels.append(level)
            for name in LEVEL:
                if level[name].__dict__.get("stored_at"):
                    keep(level[name])
            out.levels.append(level["stats"])
            out.truncated |= level["truncated"]
            reached, low = level["reached"], level["low"]
            frontier = level["followed"].select("address", F.col("height").alias("reached"))
            known.append(frontier.select("address"))
            count += reached
    for name in ("transactions", "hops", "coinjoin_stops", "service_stops", "links", "activity"):
        tables = [_tables(level, depth)[name] for depth, level in enumerate(levels, 1)]
        setattr(out, name, _union(tables) if tables else None)
    out.unexplored = frontier.select("address")
    return out


def _name(rule: dict) -> str:
    return hashlib.sha256(json.dumps(rule, sort_keys=True).encode()).hexdigest()[:24]


def _store_level(level: dict, folder: str | None, depth: int) -> None:
    """The level's tables, and last what says that they are whole."""
    if folder is None:
        return
    spark = level["info"].sparkSession
    for name in LEVEL:
        level[name].write.mode("overwrite").parquet(f"{folder}/level={depth}/{name}")
    said = json.dumps({k: level[k] for k in ("stats", "truncated", "reached", "low")})
    spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/level={depth}/said")


def _stored_level(spark, folder: str | None, depth: int) -> dict | None:
    if folder is None:
        return None
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/level={depth}/said/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return None
    level = json.loads(spark.read.text(f"{folder}/level={depth}/said").first()[0])
    return level | {name: spark.read.parquet(f"{folder}/level={depth}/{name}") for name in LEVEL}


def _level(ledger: Ledger, frontier: DataFrame, before: list[dict], known: DataFrame, count: int, low: int, depth: int, cap: int | None, min_sats: int, least: int, round_unit: int) -> dict:
    """A level's tables, statistics and what the next one needs."""
    hits = materialize(_reaches(ledger, frontier), "trace-hits")
    spends = whole(ledger, hits).where("height >= reached")
    again = F.lit(False)
    if before:
        seen = _union([x["info"].select("key") for x in before]).withColumn("again", F.lit(True))
        spends, again = spends.join(seen.hint("merge"), "key", "left"), F.coalesce("again", F.lit(False))
    spends = spends.withColumn("again", again).withColumn("ord", order_key())
    new, seen = measured(spends, "trace-new", "NOT again", n="count(*)")
    touching = blocks_touching(ledger, frontier, low, hits)
    new = with_mix(new.drop("again"))
    solved = _solved(new, known, count, cap, min_sats, least)
    chosen = solved["followed"].groupBy("key").agg(F.collect_list("n").alias("followed_n"))
    info = new.join(solved["strangers"].drop("n_out", "mix").hint("merge"), "key", "left").fillna(0, ["all_inputs", "outside"]).fillna(False, ["sweep"])
    info = info.withColumn("stop", ~F.col("mix") & F.col("sweep") & (F.col("n_out") <= 2)).withColumn("batch_sweep", F.col("sweep") & (F.col("n_out") > 2))
    info = with_change(info.withColumn("date", to_day(F.col("time"))).withColumn("depth", F.lit(depth)), round_unit)
    info = materialize(info.join(chosen.hint("merge"), "key", "left"), "trace-info")
    stats = {"candidate_blocks": touching, "blocks_touching": touching, "spending_txs": seen["n"]}
    return {"info": info, "stats": stats} | {k: solved[k] for k in ("followed", "truncated", "reached", "low")}


def _solved(new: DataFrame, known: DataFrame, count: int, cap: int | None, min_sats: int, least: int) -> dict:
    """Solve a level: followed (address, height, ord, n, key), strangers (key, n_out, mix, all_inputs, outside, sample, sweep), and what was counted."""
    known = known.withColumn("known", F.lit(True)).hint("merge")
    inputs = new.select("key", "ord", "n_out", "mix", F.posexplode(spend_order()).alias("at", "address")).join(known, "address", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    paying = new.where("NOT mix").select("key", "ord", "height", F.col("outs.n").alias("n"), F.col("outs.address").alias("a"), F.col("outs.sats").alias("sats"))
    room = None if cap is None else max(0, cap - count)
    sums = {"n": "count(*)", "low": "min(height)"}

    def reach(stops: DataFrame | None) -> tuple[DataFrame, dict, bool]:
        live = paying if stops is None else paying.join(stops.hint("merge"), "key", "left_anti")
        live = live.select("key", "ord", "height", F.explode(F.arrays_zip("n", "a", "sats")).alias("x")).select("key", "ord", "height", "x.n", F.col("x.a").alias("address"), "x.sats")
        live = live.where(F.col("address").isNotNull() & (F.col("sats") >= min_sats)).drop("sats").join(known, "address", "left_anti")
        first = live.groupBy("address").agg(F.min(F.struct("ord", "n", "height", "key")).alias("x")).select("address", "x.ord", "x.n", "x.height", "x.key")
        first, seen = measured(first, "level-reached", **sums)
        if room is None or seen["n"] <= room:
            return first, seen, False
        return *measured(first.orderBy("ord", "n").limit(room), "level-capped", **sums), True

    def strangers(reached: DataFrame) -> tuple[DataFrame, dict]:
        since = reached.select("address", F.col("ord").alias("since"))
        seen = inputs.join(since.hint("merge"), "address", "left").withColumn("outside", ~F.col("known") & (F.col("since").isNull() | (F.col("since") >= F.col("ord"))))
        lists = seen.groupBy("key", "n_out", "mix").agg(
            F.count("*").alias("all_inputs"), F.count_if("outside").alias("outside"), F.array_sort(F.collect_list(F.when(F.col("outside"), F.struct("at", "address")))).alias("who")
        )
        lists = lists.withColumn("sample", F.slice(F.transform("who", lambda x: x["address"]), 1, SAMPLE)).drop("who")
        lists = lists.withColumn("sweep", (F.col("outside") >= least) & F.lit(least > 0)).withColumn("ends", F.col("sweep") & ~F.col("mix") & (F.col("n_out") <= 2))
        return measured(lists, "level-strangers", n="count_if(ends)", h="sum(CASE WHEN ends THEN xxhash64(key) & 1099511627775 END)")

    stops, before = None, {"n": 0, "h": None}
    while True:
        reached, counted, truncated = reach(stops)
        found, now = strangers(reached)
        if now == before:
            return {"followed": reached, "strangers": found.drop("ends"), "truncated": truncated, "reached": counted["n"], "low": counted["low"] or 0}
        before, stops = now, found.where("ends").select("key")


COMMON = ("depth", "height", "date", "txid", "ord", "spenders")


def _hops(info: DataFrame) -> DataFrame:
    rows = labelled(info.where("NOT mix AND NOT stop"), *[c for c in COMMON if c != "txid"], "followed_n").where("address IS NOT NULL")
    return rows.select(*COMMON, "n", "address", "sats", "label", "reasons", F.coalesce(F.array_contains("followed_n", F.col("n")), F.lit(False)).alias("followed"))


def _links(info: DataFrame) -> DataFrame:
    """(src, dst, kind, txid, height, batch_sweep): inputs spent together, and change."""
    plain = info.where("NOT mix AND NOT stop")
    of = lambda src, dst, kind: (src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), "txid", "height", "batch_sweep")
    each = plain.select("txid", "height", "batch_sweep", spend_order().alias("every"))
    together = each.select(*of(F.get("every", F.lit(0)), F.explode(F.slice("every", 2, F.greatest(F.size("every"), F.lit(1)))), "common input"))
    change = plain.where("change_n IS NOT NULL").withColumn("to", F.explode(F.filter("outs", lambda o: o["n"] == F.col("change_n")))).where("to.address IS NOT NULL")
    return together.union(change.select(*of(F.col("spenders")[0], F.col("to.address"), "change")))


def _activity(info: DataFrame) -> DataFrame:
    """(txid, address, height, time, ord, sats, returned): what each spender put into a transaction, and got back from it."""
    none = F.lit(0).cast("long")
    moved = lambda side, spent, back: info.select("key", F.explode(side).alias("x")).select("key", "x.address", F.lit(None).alias("t"), spent, back)
    said = F.struct("txid", "height", "time", "ord")
    mine = info.select("key", F.explode("spenders").alias("address"), said.alias("t"), none.alias("sats"), none.alias("returned"))
    rows = mine.union(moved("ins", F.col("x.sats"), none)).union(moved("outs", none, F.col("x.sats"))).where("address IS NOT NULL")
    sums = rows.groupBy("key", "address").agg(F.max("t").alias("t"), F.coalesce(F.sum("sats"), none).alias("sats"), F.coalesce(F.sum("returned"), none).alias("returned"))
    return sums.where("t IS NOT NULL").select("t.txid", "address", "t.height", "t.time", "t.ord", "sats", "returned")


def _tables(level: dict, depth: int) -> dict[str, DataFrame]:
    """What a level adds to a Trace's tables."""
    info = level["info"]
    to = F.when(F.size("outs") > 0, F.transform("outs", lambda o: F.struct(o["n"].alias("n"), o["address"].alias("address"), o["sats"].alias("sats"))))
    return {
        "transactions": info.select("txid", "height", "date", "all_inputs", "outside", "sample", "n_out", "batch_sweep"),
        "hops": _hops(info),
        "coinjoin_stops": info.where("mix").select(*COMMON, "traced_sats"),
        "service_stops": info.where("stop").select(*COMMON, "all_inputs", "outside", to.alias("outputs"), "traced_sats"),
        "links": _links(info),
        "activity": _activity(info),
    }


def seed_summaries(found: Trace) -> DataFrame:
    """(address, spending_txs, spent, returned, net_out, first/last height and day) of every seed, the largest net first."""
    own = found.activity.join(found.seeds.hint("merge"), "address", "left_semi") if found.activity is not None else None
    empty = found.seeds.select("address")
    if own is None:
        return empty.selectExpr("address", "0L spending_txs", "0L spent", "0L returned", "0L net_out")
    sums = own.groupBy("address").agg(
        F.count("*").alias("spending_txs"),
        F.sum("sats").alias("spent"),
        F.sum("returned").alias("returned"),
        F.min(F.struct("ord", "height", "time")).alias("a"),
        F.max(F.struct("ord", "height", "time")).alias("z"),
    )
    every = empty.join(sums.hint("merge"), "address", "left").fillna(0, ["spending_txs", "spent", "returned"])
    return every.select(
        "address",
        "spending_txs",
        "spent",
        "returned",
        (F.col("spent") - F.col("returned")).alias("net_out"),
        F.col("a.height").alias("first_spend_height"),
        to_day(F.col("a.time")).alias("first_spend"),
        F.col("z.height").alias("last_spend_height"),
        to_day(F.col("z.time")).alias("last_spend"),
    ).orderBy(F.desc("net_out"), "address")
