"""Near-duplicate documents by min-max hashing.

Every hash function is evaluated once per shingle and gives two values, its minimum and its maximum over the
document; both are banded. Documents that share a band are candidates, and a candidate pair is a link only if
the full shingle sets confirm it.

Work is done on distinct texts. In a bucket, every text is compared with one pivot, the text whose buckets are
the fullest (copies of a common original meet in the original's buckets). The links found give components. Buckets that
hold several are gone through again, texts of different components only. First, where a component has many texts in a
bucket, texts of others are compared with a few of them, drawn anew in every turn. Then all pairs that are left are looked
at: small buckets pair by pair, large ones by a prefix filter on their texts' shingles. So no link between components is
lost, and a group of many copies, linked by then, doesn't become its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.operators.graph import connected_components
from ledgerflow.session import keep, materialize, measured, scratch

#: Hash functions; each gives a minimum and a maximum, so there are twice as many values.
HASHES = 48
#: Values per band: 24 bands of 4 miss a pair of similarity 0.8 once in 300,000.
ROWS = 4
#: A sketch holds 4 bits of each value. Of a pair of similarity 0.8, 78 of 96 agree on average (chance included), and
#: fewer than this once in 200,000: such a pair isn't looked at in the second round.
LEAST_EQUAL = 60
#: The threshold that bands and LEAST_EQUAL are tuned to; above it they miss less.
LEAST_PERCENT = 80
SKETCH = tuple(f"s{i}" for i in range(2 * HASHES // 16))
#: Buckets of up to so many texts are compared pair by pair in the second round; larger ones by shared shingles.
SMALL_BUCKET = 12
#: Turns at most in which texts are compared with drawn ones of a large component, and draws in a bucket; a turn's pairs
#: are so many times its rows at most.
TURNS, DRAWS = 3, 4
#: Pairs tried in a turn agree in so many values: 95% of the links at 0.8, and few others. The rest waits for the last round.
TURN_EQUAL = 72
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
#: Entries kept of the word hashes before they are forgotten.
_WORDS_KEPT = 1 << 18
_BLOCK = 1 << 14


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[3]
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``words`` words, A-Z lower-cased; fewer words make one shingle."""
    if not text:
        return np.empty(0, np.uint64)
    parts = text.encode("utf-8", "replace").lower().split()  # bytes: ASCII case and white space only
    n = len(parts)
    if n == 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, parts), np.uint64, n)
    span = min(words, n)
    total = np.full(n - span + 1, span * int(_MIX[4]) % (1 << 64), np.uint64)
    for i in range(span):
        total = _stir(total + h[i : n - span + 1 + i]) * _MIX[i % 3]
    return np.unique(_stir(total))


def _coefficients(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return (rng.integers(0, 1 << 31, (hashes, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, (hashes, 1), dtype=np.uint32))


def min_max(shingles: np.ndarray, coefficients) -> np.ndarray:
    """Minimum and maximum of every permutation x -> ax + b of the 32-bit numbers, one evaluation each."""
    a, b = coefficients
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = high = None
    for i in range(0, len(x), _BLOCK):
        y = a * x[i : i + _BLOCK] + b
        lo, hi = y.min(axis=1), y.max(axis=1)
        low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
    return np.concatenate((low, high))


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """(documents, values) to (documents, bands): a 64-bit key of each band's values and place."""
    n, values = signatures.shape
    parts = signatures.reshape(n, values // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, values // rows + 1, dtype=np.uint64) * _MIX[4], parts.shape[:2]).copy()
    for i in range(rows):
        key = _stir(key + parts[:, :, i]) * _MIX[i % 3]
    return key.view(np.int64)


def sketches(signatures: np.ndarray) -> list[np.ndarray]:
    """The last 4 bits of every value, packed into longs: one array for each name in SKETCH."""
    low = (signatures & np.uint32(15)).astype(np.uint64).reshape(len(signatures), len(SKETCH), -1)
    packed = np.zeros(low.shape[:2], np.uint64)
    for i in range(low.shape[2]):
        packed = packed << np.uint64(4) | low[:, :, i]
    return [np.ascontiguousarray(c).view(np.int64) for c in packed.T]


def _alike(x: str, y: str, least: int = LEAST_EQUAL) -> str:
    """SQL: the sketches of x and y agree in ``least`` values at least."""
    differ = []
    for s in SKETCH:
        z = f"({x}.{s} ^ {y}.{s})"
        differ.append(f"bit_count(({z} | shiftrightunsigned({z}, 1) | shiftrightunsigned({z}, 2) | shiftrightunsigned({z}, 3)) & 1229782938247303441L)")
    return f"{' + '.join(differ)} <= {2 * HASHES - least}"


def _signer(words: int, hashes: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coefficients = _coefficients(hashes)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sizes, signatures = [], np.zeros((part.num_rows, 2 * hashes), np.uint32)
                for i, text in enumerate(part.column("text")):
                    s = shingle_set(text.as_py(), words)
                    sizes.append(len(s))
                    if len(s):
                        signatures[i] = min_max(s, coefficients)
                keys = band_keys(signatures, rows)
                per = keys.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("key"),
                        pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, per * part.num_rows + 1, per), pa.int32()), pa.array(keys.reshape(-1))),
                        *map(pa.array, sketches(signatures)),
                    ],
                    names=["id", "key", "n", "bands", *SKETCH],
                )

    return sign


def _verifier(words: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last = None, None
        for batch in batches:
            hits = []
            for i, (v, a, b) in enumerate(zip(*(batch.column(c) for c in ("v", "a", "b")), strict=True)):
                v = v.as_py()
                if v != last_key:
                    last_key, last = v, shingle_set(b.as_py(), words)
                mine = shingle_set(a.as_py(), words)
                if 100 * min(len(mine), len(last)) < percent * max(len(mine), len(last)):
                    continue
                both = len(np.intersect1d(mine, last, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(last) - both):
                    hits.append(i)
            yield batch.select(["u", "v"]).take(pa.array(hits, pa.int32()))

    return verify


def _tokens(words: int):
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, head, text in zip(*(batch.column(c) for c in ("doc", "head", "text")), strict=True):
                s = shingle_set(text.as_py(), words).view(np.int64)
                own = [pa.array(np.full(len(s), x.as_py(), np.int64)) for x in (doc, head)]
                yield pa.RecordBatch.from_arrays([pa.array(s), *own, pa.array(np.full(len(s), len(s), np.int64))], names=["token", "doc", "head", "n"])

    return tokens


def _across(texts: DataFrame, ends: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (u, v) of (node, doc, head) rows with different heads that may be links; every link is among them.

    A link needs at least p = percent / 100 of either document's shingles in common. Only shingles seen under
    several heads can be; documents with too few of them are out. The rest meet in the rarest of these shingles, as
    many as leave less than the needed number (prefix filter). Where two first meet, what is left of either from
    there on must allow the link, and so must sizes and sketches.

    What is left also bounds the size of a document's partners. A place in a shingle's list is given up where no other
    document of the list is within it: documents that have a long passage in common, but each too much of its own, never meet.
    """
    p = percent
    told = ends.join(_grows(texts), "node").select("doc", "head", "text").mapInArrow(_tokens(words), "token long, doc long, head long, n long")
    rows = materialize(told, "minmax-tokens")
    shared = rows.groupBy("token").agg(F.min("head").alias("lo"), F.max("head").alias("hi"), F.count("*").alias("df")).where("lo <> hi").select("token", "df")
    common = rows.join(_grows(materialize(shared, "minmax-shared")), "token")
    whole, rarest = Window.partitionBy("doc"), Window.partitionBy("doc").orderBy("df", "token")
    able = common.withColumn("r", F.count("*").over(whole)).where(f"100 * r >= {p} * n").withColumn("at", F.row_number().over(rarest))
    most = F.expr(f"floor((100 + {p}) * (r - at + 1) / {p}) - n")  # of a partner's shingles
    prefix = able.where(f"at <= r - ceil({p} * n / 100) + 1").withColumn("most", most).select("token", "doc", "head", "n", "r", "at", "most")
    prefix = materialize(prefix, "minmax-prefix")
    lists = prefix.groupBy("token").agg(F.min("n").alias("least"), F.max("most").alias("room"), F.min("head").alias("lo"), F.max("head").alias("hi"))
    lists = materialize(lists.where("lo <> hi AND least <= room").select("token", "least", "room"), "minmax-lists")
    prefix = prefix.join(_grows(lists), "token").where("least <= most AND n <= room").drop("least", "room", "most")
    prefix = materialize(prefix.join(_grows(ends.select("doc", "node", *SKETCH)), "doc"), "minmax-meeting")
    need = f"{p} * (x.n + y.n)"  # 100 + p times the shingles in common
    sizes = f"x.head < y.head AND 100 * x.n >= {p} * y.n AND 100 * y.n >= {p} * x.n"
    fits = f"{sizes} AND (100 + {p}) * (1 + least(x.r - x.at, y.r - y.at)) >= {need} AND {_alike('x', 'y')}"
    met = prefix.alias("x").join(_grows(prefix.alias("y")), "token").where(fits)
    return met.select(F.col("x.node").alias("u"), F.col("y.node").alias("v"))


def _grows(table: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: never broadcast, so the plan is one at every size."""
    return table.hint("merge")


def text_key(text):
    return F.unhex(F.md5(text.cast("binary")))


def row_key(least_id, key):
    """A row's key, and with its smallest id a text's node: whether the id is null, the id in an order of bytes, the text's key or nothing."""
    ordered = F.unhex(F.lpad(F.hex(F.coalesce(least_id, F.lit(0).cast("long")).bitwiseXOR(F.lit(-1 << 63).cast("long"))), 16, "0"))
    return F.concat(F.when(least_id.isNull(), F.lit(b"\1")).otherwise(F.lit(b"\0")), ordered, F.coalesce(key, F.lit(b"")))


def _least_id(node):
    """The id in a node, the inverse of row_key()."""
    number = F.conv(F.hex(F.substring(node, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-1 << 63).cast("long"))
    return F.when(F.substring(node, 1, 1) == F.lit(b"\0"), number)


def _drawn(rows: DataFrame, turn: int) -> DataFrame:
    """Up to DRAWS texts of every bucket's largest component, if it has over SMALL_BUCKET there; others in every turn: (band, part, node)."""
    draws = [F.min_by("node", F.xxhash64("node", "band", F.lit(turn * DRAWS + i))).alias(f"d{i}") for i in range(DRAWS)]
    names = [f"d{i}" for i in range(DRAWS)]
    largest = rows.groupBy("band", "part").agg(F.count("*").alias("many"), *draws).where(f"many > {SMALL_BUCKET}").groupBy("band").agg(F.max(F.struct("many", "part", *names)).alias("top"))
    return largest.select("band", "top.part", F.explode(F.array_distinct(F.array(*[f"top.{n}" for n in names]))).alias("node"))


def _links(base: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (u, v) between the nodes of ``texts``: every pair of a bucket of similar texts that is one, or a path of them."""

    def confirmed(these: DataFrame, among: DataFrame, tag: str) -> tuple[DataFrame, int]:
        a, b = (among.select(F.col("node").alias(n), F.col("text").alias(t)) for n, t in (("u", "a"), ("v", "b")))
        sides = these.join(_grows(a), "u").join(_grows(b), "v")
        out, seen = measured(sides.mapInArrow(_verifier(words, percent), "u binary, v binary"), tag, n="count(*)")
        return out, seen["n"]

    def apart(rows: DataFrame, links: DataFrame) -> tuple[DataFrame, dict]:
        """The rows (band, held, node, part) of buckets that hold several components, part being a text's component."""
        named = connected_components(links, "u", "v")
        placed = rows.join(_grows(named), "node", "left").select("band", "held", "node", F.coalesce("component", "node").alias("part"))
        placed = materialize(placed, "minmax-placed")
        several = placed.groupBy("band").agg(F.min("part").alias("first"), F.max("part").alias("last")).where("first <> last").select("band")
        several = materialize(several, "minmax-apart")
        return measured(placed.join(_grows(several), "band"), "minmax-still", n="count(*)", large=f"count_if(held > {SMALL_BUCKET})")

    def ordered(these: DataFrame) -> DataFrame:
        return these.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))

    bands = texts.select("node", F.explode("bands").alias("band"))
    buckets = materialize(bands.groupBy("band").agg(F.count("*").alias("held")).where("held > 1"), "minmax-buckets")
    # a text has a row per band: its sum is over 24 rows at most
    members = bands.join(_grows(buckets), "band").withColumn("central", F.sum("held").over(Window.partitionBy("node")))
    members = materialize(members, "minmax-members")
    pivots = members.groupBy("band").agg(F.max(F.struct("central", "node")).alias("top")).select("band", F.col("top.node").alias("v"))
    met = members.select("band", "node").join(_grows(materialize(pivots, "minmax-pivots")), "band").where("node <> v")
    pairs = materialize(met.select(F.col("node").alias("u"), "v").distinct(), "minmax-pairs")
    needed = texts.join(_grows(members.select("node").distinct()), "node", "left_semi").select("node", F.col("key").alias("k"), F.col("least_id").alias("i"))
    copies = base.join(_grows(needed), (base.key == needed.k) & base.id.eqNullSafe(needed.i))
    held = materialize(copies.groupBy("node").agg(F.first("text").alias("text")), "minmax-held")
    links, _ = confirmed(pairs, held, "minmax-links")
    tried = ordered(pairs)
    sketched = texts.select("node", "n", *SKETCH)
    sizes = f"100 * x.n >= {percent} * y.n AND 100 * y.n >= {percent} * x.n"
    still, seen = apart(members.select("band", "held", "node"), links)
    if seen["large"]:
        mass = materialize(held.join(_grows(still.where(F.col("held") > SMALL_BUCKET).select("node").distinct()), "node", "left_semi"), "minmax-mass")
    for turn in range(TURNS):
        if not seen["large"]:
            break
        large = still.where(F.col("held") > SMALL_BUCKET)
        drawn = materialize(_drawn(large, turn).join(_grows(sketched), "node"), "minmax-drawn")
        met = large.join(_grows(sketched), "node").alias("x").join(_grows(drawn.alias("y")), "band").where(f"x.part <> y.part AND {sizes} AND {_alike('x', 'y', TURN_EQUAL)}")
        met = ordered(met.select(F.col("x.node").alias("u"), F.col("y.node").alias("v"))).distinct().join(_grows(tried), ["u", "v"], "left_anti")
        met, many = measured(met, "minmax-turn", n="count(*)")
        if not many["n"]:
            break
        more, n = confirmed(met, mass, "minmax-turned")
        tried = tried.union(met)
        if not n:
            break
        links = links.union(more)
        still, seen = apart(still.drop("part"), links)
    if not seen["n"]:
        return links
    small = still.where(F.col("held") <= SMALL_BUCKET).join(_grows(sketched), "node")
    likely = small.alias("x").join(_grows(small.alias("y")), "band").where(f"x.part < y.part AND {sizes} AND {_alike('x', 'y')}").select(F.col("x.node").alias("u"), F.col("y.node").alias("v"))
    if seen["large"]:
        ends = still.where(F.col("held") > SMALL_BUCKET).select("node", F.xxhash64("node").alias("doc"), F.xxhash64("part").alias("head")).distinct()
        ends = materialize(ends.join(_grows(texts.select("node", *SKETCH)), "node"), "minmax-ends")
        likely = likely.union(_across(mass, ends, words, percent))
    likely = ordered(likely).distinct().join(_grows(tried), ["u", "v"], "left_anti")
    likely, many = measured(likely, "minmax-likely", n="count(*)")
    if many["n"]:
        links = links.union(confirmed(likely, held, "minmax-more")[0])
    return links


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, hashes: int = HASHES, rows: int = ROWS) -> DataFrame:
    """Components of near-duplicate documents: (doc_id, key, n_shingles, component_id, kept), one row per row of ``docs``.

    Two texts are linked if 100 * |A and B| >= percent * |A or B| over their sets of ``words``-word shingles. key
    is the text's MD5; component_id is the smallest doc_id among all rows whose text can be reached; kept says that
    doc_id is that one. Defined results: a text that is null or has no words has no shingles and is linked with
    nothing, its component is its own doc_id; equal texts are linked; rows alike are each returned, alike; a null
    doc_id is never the smallest unless all are null, and is not kept beside others; an empty table gives none.
    Bands and sketches are tuned to 80 percent: lower thresholds and other numbers of hash functions or rows are refused.
    """
    if not LEAST_PERCENT <= percent <= 100 or hashes != HASHES or rows != ROWS:
        raise ValueError(f"percent {percent}, hashes {hashes}, rows {rows}: bands and sketches are for {LEAST_PERCENT} to 100, {HASHES} and {ROWS}")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("key", text_key(F.col("text")))
    with scratch():
        signed = materialize(base.mapInArrow(_signer(words, hashes, rows), "id long, key binary, n long, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCH)), "minmax-signed")
        texts = signed.where("n > 0").groupBy("key").agg(F.min("id").alias("least_id"), F.max("n").alias("n"), F.first("bands").alias("bands"), *[F.max(s).alias(s) for s in SKETCH])
        texts = materialize(texts.withColumn("node", row_key(F.col("least_id"), F.col("key"))), "minmax-texts")
        # a component's smallest node holds its smallest id
        parts = connected_components(_links(base, texts, words, percent), "u", "v")
        named = texts.select("key", "node").join(_grows(parts), "node", "left").select("key", F.coalesce("component", "node").alias("component"))
        named = materialize(named.select("key", F.substring("component", 10, 16).alias("component_key"), _least_id(F.col("component")).alias("component_id")), "minmax-named")
        out = keep(signed).select("id", "key", "n").join(_grows(keep(named)), "key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias("doc_id"),
        "key",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
        F.coalesce("component_key", "key").alias("component_key"),
    )


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return link(docs, words=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")
