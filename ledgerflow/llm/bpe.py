"""Byte-level BPE encoding and decoding by ranked merges.

A text is split by the public pattern; every piece starts as single bytes, and the adjacent pair whose joined
bytes have the smallest rank is merged, the leftmost first, until no pair has a rank. Decoding joins the bytes of
the ids.

Two forms give the same ids. ``fold_pieces`` is the fold in Spark's higher-order functions, with the ranks as a
literal table, for a column of distinct pieces. ``encode`` runs the same merges in Arrow batches and remembers
pieces; the query uses it, since the fold takes several times the CPU time that whole tables may (see README).
"""

from __future__ import annotations

import base64
import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
#: Pieces remembered by a worker before they are forgotten: a bound on its memory.
PIECES_KEPT = 400_000
#: Buckets of the literal rank table.
BUCKETS = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines: base64 of the bytes, the rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: repeatedly join the adjacent pair of smallest rank, the leftmost of equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 256:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = len(ranks)
    get = ranks.get
    pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        at = pairs.index(least)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = get(parts[at - 1] + parts[at], none)
        if at < len(pairs):
            pairs[at] = get(parts[at] + parts[at + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As merge(), by a heap over a linked list: n log n for very long pieces."""
    from heapq import heapify, heappop, heappush

    n = len(piece)
    ends, before, after, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), bytearray(b"\1" * n)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(piece[i : ends[j]])) is not None:
            heappush(heap, (r, i, ends[j]))

    while heap:
        _, i, end = heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or ends[j] != end:
            continue
        ends[i], alive[j], after[i] = end, 0, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = after[i]
    return out


def _packed(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    from sys import byteorder

    a = array("I", ids)
    if byteorder == "big":
        a.byteswap()
    return a.tobytes()


class Codec:
    """Ranks, pattern and remembered pieces of one worker."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.pieces = _Pieces(self.ranks)
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        found = self.pieces
        if len(found) > PIECES_KEPT:
            found.clear()
        return b"".join([found[p] for p in self.split(text)])

    def decode(self, packed: bytes) -> bytes:
        """Bytes of packed ids."""
        table = self.bytes_of
        return b"".join([table[i] for i in memoryview(packed).cast("I")])


class _Pieces(dict):
    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        ids = _packed(merge(piece.encode("utf-8", "replace"), self.ranks))
        if len(piece) <= 64:
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every whole text, an array of ints. Null texts count as empty and have no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = [list(memoryview(own.encode(t.as_py() or "")).cast("I")) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes): the joined bytes of an array of ids. Null arrays give empty bytes; unknown ids are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            raw = [own.decode(_packed(ids.as_py() or ())) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "bytes"])

    return coded.select(id_col, ids_col).mapInArrow(run, "doc_id long, bytes binary")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode its ids, and return digests of both: (doc_id, n_tokens, ids_sha256, decoded_sha256).

    One row per row of ``docs``: null texts count as empty; rows alike give rows alike; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            numbers, coded, plain = [], [], []
            for text in batch.column(1):
                packed = own.encode(text.as_py() or "")
                numbers.append(len(packed) // 4)
                coded.append(hashlib.sha256(packed).hexdigest())
                plain.append(hashlib.sha256(own.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(numbers, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())], names=[x.split()[0] for x in DIGESTS.split(", ")]
            )

    return docs.select(id_col, text_col).mapInArrow(run, DIGESTS)


def pieces(docs: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """Distinct pieces of all texts: (piece). Null and empty texts have none, other columns are left aside, an empty table gives none."""
    return docs.select(F.explode(F.regexp_extract_all(text_col, F.lit("(?U)" + pattern), F.lit(0))).alias("piece")).distinct()


def fold_pieces(words: DataFrame, path: str) -> DataFrame:
    """(piece, ids) for a column of distinct pieces, by higher-order functions only.

    The state of the fold is the piece's parts, as hex, and the rank of each adjacent pair; a step joins the first
    pair of smallest rank and looks up its two new neighbours. The ranks are a literal array of small maps, found by hash.
    Null and empty pieces are left out, as are other columns; rows alike give rows alike; an empty table gives none.
    """
    spark = words.sparkSession
    ranks = spark.createDataFrame([(t.hex(), r) for t, r in read_ranks(path).items()], "h string, r int")
    table: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for at, h, r in ranks.select(F.pmod(F.hash("h"), F.lit(BUCKETS)), "h", "r").collect():
        table[at][h] = r
    literal = f"from_json('{json.dumps(table, separators=(',', ':'))}', 'array<map<string,int>>')"
    none = "cast(array() as array<int>)"

    def rank(joined: str) -> str:
        return f"try_element_at(try_element_at({literal}, pmod(hash({joined}), {BUCKETS}) + 1), {joined})"

    start = words.select("piece", F.expr("lower(hex(encode(piece, 'utf-8')))").alias("h")).where("h <> ''")
    start = start.select("piece", F.expr("transform(sequence(1, length(h), 2), i -> substring(h, i, 2))").alias("p"))
    start = start.withColumn("r", F.expr(f"case when size(p) < 2 then {none} else transform(sequence(1, size(p) - 1), i -> {rank('concat(p[i - 1], p[i])')}) end"))
    joined = "concat(slice(a.p, 1, j - 1), array(concat(a.p[j - 1], a.p[j])), slice(a.p, j + 2, size(a.p)))"
    left = f"case when j > 1 then array({rank('concat(q[j - 2], q[j - 1])')}) else {none} end"
    right = f"case when j < size(q) then array({rank('concat(q[j - 1], q[j])')}) else {none} end"
    pairs = f"concat(slice(a.r, 1, greatest(j - 2, 0)), {left}, {right}, slice(a.r, j + 2, size(a.r)))"
    step = f"element_at(transform(array(cast(array_position(a.r, array_min(a.r)) as int)), j -> element_at(transform(array({joined}), q -> named_struct('p', q, 'r', {pairs})), 1)), 1)"
    folded = start.select("piece", F.expr(f"aggregate(p, named_struct('p', p, 'r', r), (a, x) -> case when array_min(a.r) is null then a else {step} end)").alias("s"))
    return folded.select("piece", F.expr(f"transform(s.p, x -> {rank('x')})").alias("ids"))


def op4(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)
