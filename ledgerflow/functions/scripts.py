"""Output scripts as column expressions: class, label, visibility of the key, hash committed to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The node software's names of script classes, their labels, and their patterns in hex, in the order tried.
P2PK, P2MS, P2PKH, P2SH = "pubkey", "multisig", "pubkeyhash", "scripthash"
P2WPKH, P2WSH, P2TR, ANCHOR = "witness_v0_keyhash", "witness_v0_scripthash", "witness_v1_taproot", "anchor"
NULLDATA, WITNESS_UNKNOWN, NONSTANDARD = "nulldata", "witness_unknown", "nonstandard"
KEY_IN_OUTPUT = (P2PK, P2MS, P2TR)
HASH_ONLY = (P2PKH, P2SH, P2WPKH, P2WSH)
LABELS = {
    P2PK: "P2PK",
    P2MS: "bare multisig",
    P2PKH: "P2PKH",
    P2SH: "P2SH",
    P2WPKH: "P2WPKH",
    P2WSH: "P2WSH",
    P2TR: "P2TR (Taproot)",
    ANCHOR: "anchor",
    NULLDATA: "OP_RETURN",
    WITNESS_UNKNOWN: "future witness version",
    NONSTANDARD: "nonstandard",
}
KEY_PUSH = "(?:21[0-9a-f]{66}|41[0-9a-f]{130})"
NUMBER = "(?:5[1-9a-f]|60)"
PATTERNS = (
    (P2PKH, "76a914[0-9a-f]{40}88ac"),
    (P2SH, "a914[0-9a-f]{40}87"),
    (P2WPKH, "0014[0-9a-f]{40}"),
    (P2WSH, "0020[0-9a-f]{64}"),
    (P2TR, "5120[0-9a-f]{64}"),
    (ANCHOR, "51024e73"),
    (P2PK, f"{KEY_PUSH}ac"),
    (P2MS, f"{NUMBER}{KEY_PUSH}+{NUMBER}ae"),
    (NULLDATA, "6a[0-9a-f]*"),
)


def script_type(script: Column) -> Column:
    """Class of a script in hex, either case; null for null. The first pattern that fits the whole script counts."""
    low = F.lower(script)
    version, length = (F.conv(F.substring(low, at, 2), 16, 10).cast("int") for at in (1, 3))
    witness = low.rlike("^[0-9a-f]{8,}$") & version.between(0x52, 0x60) & length.between(2, 40) & (F.length(low) == 4 + 2 * length)
    first = F.when(script.isNull(), F.lit(None).cast("string"))
    return reduce(lambda c, p: c.when(low.rlike(f"^{p[1]}$"), p[0]), PATTERNS, first).when(witness, WITNESS_UNKNOWN).otherwise(NONSTANDARD)


def once(column: Column) -> Column:
    """The column behind a one-row generator, so that the optimizer doesn't copy a long expression into each of its uses."""
    return F.explode(F.array(column))


def key_in_output(kind: Column) -> Column:
    return kind.isin(*KEY_IN_OUTPUT)


def hash_only(kind: Column) -> Column:
    return kind.isin(*HASH_ONLY)


def label(kind: Column) -> Column:
    """The class's usual name; a class not known is its own label."""
    return reduce(lambda c, x: c.when(kind == x[0], x[1]), LABELS.items(), F.when(kind.isNull(), None)).otherwise(kind)


def key_hash(script: Column, kind: Column) -> Column:
    """The hash that a hash-only script (hex) commits to, as binary; null for other classes."""
    low = F.lower(script)
    return F.unhex(
        F.when(kind == P2PKH, F.substring(low, 7, 40)).when(kind == P2SH, F.substring(low, 5, 40)).when(kind == P2WPKH, F.substring(low, 5, 40)).when(kind == P2WSH, F.substring(low, 5, 64))
    )


def hash_prefix(digest: Column) -> Column:
    """The first 8 bytes of a hash: the short form used for matching."""
    return F.substring(digest, 1, 8)


def looks_like_address(text: Column) -> Column:
    """Shape of a main-network address, legacy or segwit; no checksum is verified."""
    return text.rlike("^(?:[13][1-9A-HJ-NP-Za-km-z]{25,34}|bc1[02-9ac-hj-np-z]{11,71})$")


def to_sats(btc: Column) -> Column:
    """Whole satoshis of an amount; halves go to the even neighbour, as amounts are doubles at the edges."""
    return F.bround(btc.cast("double") * F.lit(1e8)).cast("long")


def to_btc(sats: Column) -> Column:
    return sats / F.lit(1e8)


def to_day(seconds: Column) -> Column:
    """UTC date of Unix seconds, null for null."""
    return F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))


def month_of(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("unknown"))


def age_bin(height: Column, size: int = 1000) -> Column:
    return F.floor(height / F.lit(size)).cast("int")


def is_dormant(bin_: Column, tip: Column, size: int = 1000, blocks: int = 5 * 52560) -> Column:
    """Whether a whole age bin lies at least ``blocks`` before the tip."""
    return (bin_ + 1) * size <= tip - blocks
