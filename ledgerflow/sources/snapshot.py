"""Binary snapshots of unspent outputs: header, coins, the set's hash, and a writer.

A file's numbers have no fixed width, so it can't be cut blindly. One sequential pass notes where every so many coins
a transaction begins; that index is stored beside the file and used again. Partitions then decode their stretch in
parallel. The set's hash depends on the order of all coins and is a pass of its own. Either pass holds a window of the
file, never the whole. Paths are local or any that pyarrow's file systems open (hdfs://, s3://, ...).
"""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerflow.functions.crypto import lift_key

# Fixed values of the format.
MAGIC, VERSION, HEADER, LONGEST_SCRIPT = b"utxo\xff", 2, 51, 10_000
NETWORKS = {bytes.fromhex("f9beb4d9"): "main", bytes.fromhex("0b110907"): "test", bytes.fromhex("1c163f28"): "testnet4", bytes.fromhex("0a03cf40"): "signet", bytes.fromhex("fabfb5da"): "regtest"}
#: Bytes of the file that a pass holds at a time.
WINDOW = 1 << 22
COINS = "txid string, vout long, height int, coinbase boolean, sats long, script string, compact_key boolean"


class SnapshotError(ValueError):
    """The file isn't a snapshot, or is damaged."""


@dataclass(frozen=True)
class Header:
    network: str
    base_hash: str
    coins: int


def read_header(data: bytes) -> Header:
    if len(data) < HEADER or data[:5] != MAGIC:
        raise SnapshotError("not a snapshot of unspent outputs")
    version = int.from_bytes(data[5:7], "little")
    if version != VERSION:
        raise SnapshotError(f"snapshot version {version} is not read, only {VERSION}")
    network = NETWORKS.get(data[7:11], f"unknown ({data[7:11].hex()})")
    return Header(network, data[11:43][::-1].hex(), int.from_bytes(data[43:51], "little"))


def expand_amount(packed: int) -> int:
    """Satoshis of a packed amount: trailing zeros and the last other digit are stored apart."""
    if not packed:
        return 0
    rest, zeros = divmod(packed - 1, 10)
    if zeros == 9:
        return (rest + 1) * 10**9
    high, digit = divmod(rest, 9)
    return (10 * high + digit + 1) * 10**zeros


def pack_amount(sats: int) -> int:
    if not sats:
        return 0
    zeros = 0
    while sats % 10 == 0 and zeros < 9:
        sats //= 10
        zeros += 1
    if zeros == 9:
        return 10 * (sats - 1) + 10
    high, digit = divmod(sats, 10)
    return 10 * (9 * high + digit - 1) + zeros + 1


class _Coins:
    """A cursor over the coins of a file, through a window that moves on."""

    def __init__(self, file: BinaryIO, base: int = 0) -> None:
        self.file, self.base, self.data, self.at = file, base, b"", 0

    @property
    def place(self) -> int:
        """Bytes from the file's start."""
        return self.base + self.at

    def _more(self, n: int) -> None:
        self.data, self.base, self.at = self.data[self.at :] + self.file.read(max(n, WINDOW)), self.place, 0

    def ended(self) -> bool:
        if self.at == len(self.data):
            self._more(1)
        return not self.data

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            self._more(n)
            if len(self.data) < n:
                raise SnapshotError("the file ends in the middle of a coin")
        part = self.data[self.at : self.at + n]
        self.at += n
        return part

    def size(self) -> int:
        first = self.take(1)[0]
        return first if first < 253 else int.from_bytes(self.take(1 << first - 252), "little")

    def varint(self) -> int:
        n = 0
        while True:
            byte = self.take(1)[0]
            n = n << 7 | byte & 127
            if byte < 128:
                return n
            n += 1

    def skip_coin(self) -> None:
        self.size()
        self.varint()
        self.varint()
        kind = self.varint()
        self.take(20 if kind < 2 else 32 if kind < 6 else kind - 6)

    def coin(self) -> tuple[int, int, int, bytes, bool]:
        """(vout, height and coinbase bit, satoshis, script, whether the script is a key stored compactly)."""
        vout, code, sats, kind = self.size(), self.varint(), expand_amount(self.varint()), self.varint()
        if kind == 0:
            return vout, code, sats, b"\x76\xa9\x14" + self.take(20) + b"\x88\xac", False
        if kind == 1:
            return vout, code, sats, b"\xa9\x14" + self.take(20) + b"\x87", False
        if kind < 4:
            return vout, code, sats, bytes((33, kind)) + self.take(32) + b"\xac", True
        if kind < 6:
            x = self.take(32)
            try:
                return vout, code, sats, b"\x41" + lift_key(kind, x) + b"\xac", True
            except ValueError as e:
                raise SnapshotError(str(e)) from e
        if kind - 6 > LONGEST_SCRIPT:
            raise SnapshotError(f"a script of {kind - 6} bytes is too long")
        return vout, code, sats, self.take(kind - 6), False


def index(file: BinaryIO, every: int = 1 << 20) -> list[tuple[int, int, int]]:
    """(start, end, coins) of stretches of about ``every`` coins that begin with a transaction."""
    total, cursor, done = read_header(file.read(HEADER)).coins, _Coins(file, HEADER), 0
    out, start, first = [], HEADER, 0
    while done < total:
        cursor.take(32)
        n = cursor.size()
        for _ in range(n):
            cursor.skip_coin()
        done += n
        if done - first >= every or done >= total:
            out.append((start, cursor.place, done - first))
            start, first = cursor.place, done
    if done != total:
        raise SnapshotError(f"the header says {total} coins, there are {done}")
    if not cursor.ended():
        raise SnapshotError("bytes follow the last coin")
    return out


def _groups(file: BinaryIO, base: int = 0) -> Iterator[tuple[bytes, list]]:
    cursor = _Coins(file, base)
    while not cursor.ended():
        txid = cursor.take(32)
        yield txid, [cursor.coin() for _ in range(cursor.size())]


def set_hash(file: BinaryIO) -> str:
    """The order-dependent double SHA-256 over all coins, as the node software shows it."""
    digest = hashlib.sha256()
    read_header(file.read(HEADER))
    for txid, coins in _groups(file, HEADER):
        for vout, code, sats, script, _ in coins:
            digest.update(txid + vout.to_bytes(4, "little") + code.to_bytes(4, "little") + sats.to_bytes(8, "little") + compact(len(script)) + script)
    return hashlib.sha256(digest.digest()).digest()[::-1].hex()


def compact(n: int) -> bytes:
    if n < 253:
        return bytes((n,))
    width = 2 if n < 1 << 16 else 4 if n < 1 << 32 else 8
    return bytes((252 + width.bit_length() - 1,)) + n.to_bytes(width, "little")


def varint(n: int) -> bytes:
    out = [n & 127]
    while n > 127:
        n = (n >> 7) - 1
        out.append(n & 127 | 128)
    return bytes(reversed(out))


def _packed_script(script: bytes) -> bytes:
    if len(script) == 25 and script[:3] == b"\x76\xa9\x14" and script[23:] == b"\x88\xac":
        return b"\0" + script[3:23]
    if len(script) == 23 and script[:2] == b"\xa9\x14" and script[22:] == b"\x87":
        return b"\1" + script[2:22]
    if len(script) == 35 and script[0] == 33 and script[1] in (2, 3) and script[34] == 0xAC:
        return script[1:34]
    if len(script) == 67 and script[:2] == b"\x41\4" and script[66] == 0xAC:
        try:
            if lift_key(script[65], script[2:34]) == script[1:66]:
                return bytes((4 + script[65] % 2,)) + script[2:34]
        except ValueError:
            pass
    return varint(len(script) + 6) + script


def encoded_group(txid: bytes, members: list[tuple[int, int, bool, int, bytes]]) -> bytes:
    """A transaction's (vout, height, coinbase, sats, script) coins as a snapshot holds them."""
    coins = [compact(vout) + varint(2 * height + coinbase) + varint(pack_amount(sats)) + _packed_script(script) for vout, height, coinbase, sats, script in members]
    return txid + compact(len(coins)) + b"".join(coins)


def write_snapshot(coins: list[tuple[bytes, int, int, bool, int, bytes]], network: bytes = bytes.fromhex("f9beb4d9"), base_hash: str = "00" * 32) -> bytes:
    """A snapshot of (txid, vout, height, coinbase, sats, script) coins, grouped by transaction and in order."""
    groups: dict[bytes, list] = {}
    for c in sorted(coins, key=lambda c: (c[0], c[1])):
        groups.setdefault(c[0], []).append(c[1:])
    head = MAGIC + VERSION.to_bytes(2, "little") + network + bytes.fromhex(base_hash)[::-1] + len(coins).to_bytes(8, "little")
    return head + b"".join(encoded_group(txid, members) for txid, members in groups.items())


def opened(path: str) -> BinaryIO:
    """A file to read and seek in."""
    store, inner = _store(path)
    return store.open_input_file(inner)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def header_of(path: str) -> Header:
    with opened(path) as file:
        return read_header(file.read(HEADER))


def hash_of(path: str) -> str:
    with opened(path) as file:
        return set_hash(file)


def stretches(path: str, every: int, index_path: str | None = None) -> list[tuple[int, int, int]]:
    """The index of a file, from ``index_path`` (beside the file unless named) if it is there for this file, or else made and stored there."""
    store, inner = _store(index_path or path + ".index.json")
    with opened(path) as file:
        header = read_header(file.read(HEADER))
        of = asdict(header) | {"bytes": file.size(), "every": every}
        try:
            with store.open_input_stream(inner) as kept:
                found = json.loads(kept.read())
            if found["of"] == of:
                return [tuple(x) for x in found["stretches"]]
        except (OSError, ValueError, KeyError):
            pass
        file.seek(0)
        found = index(file, every)
    try:
        with store.open_output_stream(inner) as kept:
            kept.write(json.dumps({"of": of, "stretches": found}).encode())
    except OSError:
        pass  # a folder that can't be written to: the index is made again next time
    return found


@dataclass
class Stretch(InputPartition):
    start: int
    end: int


class SnapshotReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.every, self.index_path = options["path"], int(options.get("coinsPerPartition", 1 << 20)), options.get("index")

    def partitions(self):
        return [Stretch(a, b) for a, b, _ in stretches(self.path, self.every, self.index_path)] or [Stretch(HEADER, HEADER)]

    def read(self, partition):
        with opened(self.path) as file:
            file.seek(partition.start)
            data = file.read(partition.end - partition.start)
        rows = []
        for txid, coins in _groups(io.BytesIO(data), partition.start):
            rows += [(txid[::-1].hex(), v, code >> 1, bool(code & 1), sats, script.hex(), compactly) for v, code, sats, script, compactly in coins]
            if len(rows) >= 1 << 16:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in COINS.split(", ")])


class SnapshotSource(DataSource):
    """spark.read.format("utxo_snapshot").load(path): a file that driver and executors can open by this path.

    Options: coinsPerPartition; index, where the file's index is kept.
    """

    @classmethod
    def name(cls) -> str:
        return "utxo_snapshot"

    def schema(self) -> str:
        return COINS

    def reader(self, schema) -> SnapshotReader:
        return SnapshotReader(self.options)


def read_snapshot(spark: SparkSession, path: str, coins_per_partition: int = 1 << 20) -> DataFrame:
    spark.dataSource.register(SnapshotSource)
    return spark.read.format("utxo_snapshot").option("coinsPerPartition", coins_per_partition).load(path)


def checks(header: Header, coins: int, computed_hash: str | None = None, expected: dict | None = None) -> dict:
    """Tri-state checks of a snapshot against its header and what the node said when it was written."""
    said = expected or {}
    known = lambda key, got: None if not said or got is None or (key == "txoutset_hash" and not said.get(key)) else said.get(key) == got
    return {
        "coins_match_header": coins == header.coins,
        "computed_txoutset_hash": computed_hash,
        "expected_txoutset_hash": said.get("txoutset_hash"),
        "hash_matches": known("txoutset_hash", computed_hash),
        "base_hash_matches": known("base_hash", header.base_hash),
        "coins_match_node": known("coins_written", coins),
    }
