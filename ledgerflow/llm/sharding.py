"""Sharding by fixed virtual slots, in DataFrame operations only.

A record's slot is a hash of its id modulo a fixed number of virtual slots. Bytes are summed per slot; a
versioned slot-to-shard map is stored as a table, and rebalancing edits the map, never the hash: version 1
deals slots out in turn, version 2 moves slots from the fullest to the emptiest shard until no move helps.
Planning looks at ``SLOTS`` sums, whatever the number of records.

Records without an id, or with one that many share, would make a slot too full to be moved. The records of slots above a
bound are dealt again, by a hash of the id, the text's checksum, and the record's number among those alike in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.session import keep, materialize, scratch

#: Virtual slots: a fixed number, so the map and its broadcast have a fixed size.
SLOTS = 4096
SHARDS = 24
#: A slot above one so-manieth of a shard's share is dealt again.
SMALLEST_SHARE = 16


def virtual_slot(id_col: Column, slots: int = SLOTS) -> Column:
    """Slot of an id; null ids go to the slot of the hash's seed."""
    return F.pmod(F.xxhash64(id_col.cast("string")), F.lit(slots)).cast("int")


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 1: slots dealt out in turn."""
    return [s % shards for s in range(slots)]


def rebalance(shard_of: list[int], load: list[int], shards: int, max_edits: int = 1 << 16) -> list[int]:
    """The map with slots moved, or swapped, between the fullest and the emptiest shard while that narrows the gap.

    ``shards`` may exceed those in the map: new shards start empty and fill by moves. Ties go to the smaller slot.
    """
    owner = list(shard_of)
    total = [0] * shards
    slots: list[set[int]] = [set() for _ in range(shards)]
    for slot, shard in enumerate(owner):
        total[shard] += load[slot]
        slots[shard].add(slot)
    for _ in range(max_edits):
        high = max(range(shards), key=lambda s: (total[s], -s))
        low = min(range(shards), key=lambda s: (total[s], s))
        gap = total[high] - total[low]
        if gap <= 1:
            break
        # best change d moves half of the gap; a move is a swap with nothing
        give = sorted((load[s], s) for s in slots[high] if load[s])
        take = [(0, -1), *sorted((load[s], s) for s in slots[low] if load[s])]
        best, j = None, len(take) - 1
        for mine in reversed(give):
            while j > 0 and mine[0] - take[j][0] < gap / 2:
                j -= 1
            for other in take[j : j + 2]:
                d = mine[0] - other[0]
                if 0 < d < gap and (best is None or abs(gap - 2 * d) < best[0]):
                    best = (abs(gap - 2 * d), mine, other)
        if best is None:
            break
        for (amount, slot), source, target in ((best[1], high, low), (best[2], low, high)):
            if slot >= 0:
                owner[slot] = target
                slots[source].discard(slot)
                slots[target].add(slot)
                total[source] -= amount
                total[target] += amount
    return owner


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes per virtual slot of rows with (vslot, size): ``slots`` numbers."""
    load = [0] * slots
    for slot, amount in rows.groupBy("vslot").agg(F.sum("size")).collect():
        load[slot] = int(amount)
    return load


def dealt_again(rows: DataFrame, crowded: list[int], slots: int = SLOTS) -> DataFrame:
    """``rows`` with new slots for those of ``crowded`` ones, spread by id, checksum and number among rows alike.

    Rows alike are numbered in each part of the written table first and then across parts, so no group of them meets in
    one task. The numbers of rows alike may change hands when run again; the slots that they get are the same.
    """
    alike = ("doc_id", "text_crc32", "size")
    hot = rows.where(F.col("vslot").isin(crowded))
    before = Window.partitionBy(*alike).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = hot.groupBy(*alike, "part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    here = hot.withColumn("here", F.row_number().over(Window.partitionBy(*alike, "part").orderBy("at")) - 1)
    starts = counts.select(*[F.col(c).alias("s_" + c) for c in (*alike, "part")], "start")
    same = [F.col(c).eqNullSafe(F.col("s_" + c)) for c in (*alike, "part")]
    numbered = here.join(starts, same[0] & same[1] & same[2] & same[3])
    again = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", F.col("start") + F.col("here"))
    spread = numbered.withColumn("vslot", F.pmod(again, F.lit(slots)).cast("int"))
    return rows.where(~F.col("vslot").isin(crowded)).unionByName(spread.select(*rows.columns))


def store_map(spark, versions: dict[int, list[int]], load: list[int]) -> DataFrame:
    """Write the versioned map (version, vslot, shard, bytes) to shared storage and read it back."""
    rows = [(v, s, shard, load[s]) for v, owner in sorted(versions.items()) for s, shard in enumerate(owner)]
    return materialize(spark.createDataFrame(rows, "version int, vslot int, shard int, bytes long"), "slot-map")


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put rows into shards: (doc_id, size, text_crc32, vslot, map_version, shard, slot).

    size is the text's UTF-8 bytes plus 8; slot counts the rows of a shard from 0 without gaps: virtual slots in
    order, and in them rows by id. Defined results: a null text has no bytes and the checksum of the empty text; null ids
    share a virtual slot, as do equal ids, unless that is dealt again (above); equal rows are told apart by their number
    only; an empty table gives none. Records are dealt one by one: equal texts of different ids may lie in different shards.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    with scratch():
        read = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), virtual_slot(F.col(id_col), slots).alias("vslot"))
        rows = materialize(read.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "shard-rows")
        load = slot_bytes(rows, slots)
        bound = sum(load) // (SMALLEST_SHARE * shards)
        crowded = [s for s, amount in enumerate(load) if amount > bound]
        if crowded:
            rows = materialize(dealt_again(rows, crowded, slots), "shard-rows")
            load = slot_bytes(rows, slots)
        first = first_map(shards, slots)
        table = keep(store_map(spark, {1: first, 2: rebalance(first, load, shards)}, load))
        keep(rows)
    current = table.where("version = 2").select("vslot", "shard", F.col("version").alias("map_version"))
    counts = rows.groupBy("vslot").agg(F.count("*").alias("n")).join(F.broadcast(current), "vslot")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("vslot", "shard", "map_version", "start")
    inside = Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32")
    # as many rows as virtual slots: a fixed bound
    return (
        rows.withColumn("place", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), "vslot")
        .select("doc_id", "size", "text_crc32", "vslot", "map_version", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"))
    )


def op7(spark, sf_dir: str) -> DataFrame:
    placed = assign(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")
