"""Registered queries of the sources: views of the star schema, encoded and read back, held against SQL on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.functions import scripts as S
from ledgerflow.operators import utxo as U
from ledgerflow.plans.catalog import LEDGER_SQL, SCRIPT_SQL
from ledgerflow.sources import decoded, encoded, rawblocks, sanctions, snapshot
from ledgerflow.sources import views as V

SPAN = 100


def raw_inputs(spark, d):
    got = rawblocks.raw_inputs(encoded.raw_blocks(spark, d))
    stack = F.array_join(F.transform("witness", lambda w: F.lower(F.hex(w))), "/")
    return got.select("height", "tx_index", "in_index", F.lower(F.hex("script_sig")).alias("script_sig"), stack.alias("witness"))


def raw_range_metrics(spark, d):
    return rawblocks.range_metrics(encoded.raw_blocks(spark, d), SPAN)


def spend_forms(spark, d):
    rows = rawblocks.revealed_in(encoded.raw_blocks(spark, d))
    return rows.groupBy("form", F.octet_length("key_hash").alias("width")).agg(F.count("*").alias("hashes"), F.count_distinct("key_hash").alias("distinct_hashes"))


def witness_programs(spark, d):
    rows = rawblocks.revealed_in(encoded.raw_blocks(spark, d)).where(F.octet_length("key_hash") == 32)
    return rows.groupBy(F.lower(F.hex("key_hash")).alias("program")).agg(F.count("*").alias("spends"), F.min("height").alias("first_height"))


def reveal_matches(spark, d):
    """Programs of every fifth part among what the blocks reveal."""
    script = F.concat(F.lit("512102"), F.sha2(F.concat(F.lit("k"), F.col("p_partkey").cast("string")), 256), F.lit("51ae"))
    targets = V._table(spark, d, "part").where("p_partkey % 5 = 0").select(F.unhex(F.sha2(F.unhex(script), 256)).alias("key_hash"))
    return rawblocks.reveal_scan(encoded.raw_blocks(spark, d), targets).select(F.lower(F.hex("key_hash")).alias("key_hash"))


def decoded_inputs(spark, d):
    blocks = decoded.without_coinbases(decoded.read_blocks(spark, encoded.decoded_blocks(spark, d)))
    return decoded.ledger_of(blocks).tx_in.select("txid", "in_index", "address", "type", "sats")


def decoded_outputs(spark, d):
    ledger = decoded.ledger_of(decoded.read_blocks(spark, encoded.decoded_blocks(spark, d)))
    return ledger.tx_out.select("txid", F.col("n").cast("long").alias("n"), "address", "type", "sats")


def decoded_transactions(spark, d):
    ledger = decoded.ledger_of(decoded.read_blocks(spark, encoded.decoded_blocks(spark, d)))
    return ledger.tx.select("txid", "height", "is_coinbase", F.col("n_out").cast("long").alias("n_out"))


def snapshot_coins(spark, d):
    rows = snapshot.read_snapshot(spark, encoded.snapshot_file(spark, d), 5000)
    return rows.select("txid", "vout", "height", "coinbase", "sats", "script", "compact_key")


def snapshot_checks(spark, d):
    """Header, count and hash of a snapshot."""
    path = encoded.snapshot_file(spark, d)
    header = snapshot.header_of(path)
    counted = snapshot.read_snapshot(spark, path, 5000).groupBy().agg(F.count("*").alias("coins"))
    return counted.select("coins", F.lit(header.coins).cast("long").alias("said"), F.lit(header.network).alias("network"), F.lit(header.base_hash).alias("base_hash"), F.lit(snapshot.hash_of(path)).alias("set_hash"))


def snapshot_totals(spark, d):
    coins = U.classified(snapshot.read_snapshot(spark, encoded.snapshot_file(spark, d), 5000))
    totals = U.totals(coins.withColumn("revealed", F.lit(False)), measured=False)
    return totals.select("coins", "sats", "key_in_output", "hash_only", "other", "dormant", "coinbase_p2pk_coins", "coinbase_p2pk", "tip")


def _listed(spark, d):
    return sanctions.listed_addresses(spark, encoded.sanctions_xml(spark, d))


def seed_selection(spark, d):
    return sanctions.select_seeds(sanctions.read_seeds(spark, encoded.seed_file(spark, d))).fillna("", ["sdn_ref", "sdn_name"])


def hash_prefixes(spark, d):
    coins = U.classified(V.utxo(spark, d), V.BIN_DAYS)
    return coins.where("key_hash IS NOT NULL").groupBy(F.lower(F.hex(S.hash_prefix(F.col("key_hash")))).alias("prefix")).agg(F.count("*").alias("coins"))


QUERIES = {
    "raw_inputs": raw_inputs,
    "raw_range_metrics": raw_range_metrics,
    "spend_forms": spend_forms,
    "witness_programs": witness_programs,
    "reveal_matches": reveal_matches,
    "decoded_inputs": decoded_inputs,
    "decoded_outputs": decoded_outputs,
    "decoded_transactions": decoded_transactions,
    "snapshot_coins": snapshot_coins,
    "snapshot_checks": snapshot_checks,
    "snapshot_totals": snapshot_totals,
    "listed_addresses": lambda s, d: _listed(s, d)[0],
    "rejected_addresses": lambda s, d: _listed(s, d)[1],
    "seed_selection": seed_selection,
    "hash_prefixes": hash_prefixes,
}


def _reversed(hex_: str) -> str:
    """SQL: bytes in hex, the last first."""
    return f"array_to_string(list_reverse(regexp_extract_all({hex_}, '..')), '')"


# a transaction is an order with returned lines; 62 bytes of coinbase, 10 an output
RAW_SQL = """
WITH day AS (SELECT o_orderkey, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS height FROM orders),
put AS (
  SELECT *, l_partkey % 3 AS kind, '02' || sha256('k' || l_partkey) AS shown,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1 AS INT) AS in_index
  FROM lineitem WHERE l_returnflag = 'A'),
tx AS (
  SELECT l_orderkey, height, CAST(row_number() OVER (PARTITION BY height ORDER BY l_orderkey) AS INT) AS tx_index, n_in, n_out, plain, scripts, taproots
  FROM (SELECT l_orderkey, count(*) AS n_in, count(*) FILTER (kind = 0) AS plain, count(*) FILTER (kind = 1) AS scripts, count(*) FILTER (kind = 2) AS taproots FROM put GROUP BY 1)
  JOIN (SELECT l_orderkey, count(*) AS n_out FROM lineitem GROUP BY 1) USING (l_orderkey) JOIN day ON o_orderkey = l_orderkey),
shown AS (
  SELECT height, tx_index, in_index, kind, l_partkey, shown, '5121' || shown || '51ae' AS script, CASE kind WHEN 0 THEN '473044' || repeat('01', 69) || '21' || shown ELSE '' END AS script_sig
  FROM put JOIN tx USING (l_orderkey))
"""
COIN_SQL = f"""coins AS (
  SELECT sha256('t' || (p_partkey // 3)) AS raw_txid, p_partkey AS vout, CAST(p_partkey * 13 % 900000 AS INT) AS height, p_size % 2 = 1 AS coinbase,
    CAST(round(p_retailprice * 100) * 1000 AS BIGINT) AS sats, script, script_type, visible, hidden, script_type = 'pubkey' AS compact_key
  FROM part JOIN hashed USING (p_partkey))"""
PARTY_SQL = """
WITH party AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS sdn_ref, CASE WHEN s_suppkey % 5 = 0 THEN 'Other ' || s_name ELSE s_name END AS sdn_name, s_suppkey % 7 <> 0 AS good,
    CASE WHEN s_suppkey % 7 = 0 THEN '0x' || translate(md5('a' || s_suppkey), '0', 'z') ELSE '1' || substr(translate(md5('a' || s_suppkey), '0', 'z'), 1, 30) END AS address
  FROM supplier)
"""

ORACLES = {
    "raw_inputs": RAW_SQL + "SELECT height, tx_index, in_index, script_sig, CASE kind WHEN 1 THEN '/' || script WHEN 2 THEN repeat('ab', 64) ELSE '' END AS witness FROM shown",
    "raw_range_metrics": RAW_SQL
    + f"""SELECT CAST(floor(height / {SPAN}) * {SPAN} AS INT) AS start, count(*) AS blocks, CAST(sum(inputs) AS BIGINT) AS inputs, CAST(sum(reveals) AS BIGINT) AS reveals, CAST(sum(bytes) AS BIGINT) AS bytes
FROM (SELECT height, sum(n_in) AS inputs, sum(2 * plain + 3 * scripts) AS reveals,
    80 + CASE WHEN count(*) + 1 < 253 THEN 1 ELSE 3 END + 62 + sum(8 + 1 + 41 * n_in + 106 * plain + 1 + 10 * n_out + CASE WHEN scripts + taproots > 0 THEN 2 + plain + 40 * scripts + 66 * taproots ELSE 0 END) AS bytes
  FROM tx GROUP BY 1) GROUP BY 1""",
    "spend_forms": RAW_SQL
    + """SELECT 'key' AS form, 20 AS width, 2 * count(*) AS hashes, 2 * count(DISTINCT l_partkey) AS distinct_hashes FROM shown WHERE kind = 0 HAVING count(*) > 0
UNION ALL SELECT 'witness script', w, CASE w WHEN 20 THEN 2 ELSE 1 END * count(*), CASE w WHEN 20 THEN 2 ELSE 1 END * count(DISTINCT l_partkey) FROM shown, (VALUES (20), (32)) v(w) WHERE kind = 1 GROUP BY w""",
    "witness_programs": RAW_SQL + "SELECT sha256(unhex(script)) AS program, count(*) AS spends, min(height) AS first_height FROM shown WHERE kind = 1 GROUP BY 1",
    "reveal_matches": RAW_SQL + "SELECT DISTINCT sha256(unhex(script)) AS key_hash FROM shown WHERE kind = 1 AND l_partkey % 5 = 0 AND l_partkey IN (SELECT p_partkey FROM part)",
    "decoded_inputs": f"WITH {LEDGER_SQL} SELECT txid, CAST(in_index AS INT) AS in_index, address, type, sats FROM tx_in",
    "decoded_outputs": f"WITH {LEDGER_SQL} SELECT txid, n, address, type, sats FROM tx_out",
    "decoded_transactions": f"WITH {LEDGER_SQL} SELECT txid, height, is_coinbase, n_out FROM tx",
    "snapshot_coins": f"WITH {SCRIPT_SQL}, {COIN_SQL} SELECT {_reversed('raw_txid')} AS txid, vout, height, coinbase, sats, script, compact_key FROM coins",
    "snapshot_checks": f"""WITH {SCRIPT_SQL}, {COIN_SQL},
part_ AS (
  SELECT raw_txid, vout, raw_txid || {_reversed("printf('%08x', vout)")} || {_reversed("printf('%08x', height * 2 + CAST(coinbase AS INT))")} || {_reversed("printf('%016x', sats)")} || printf('%02x', length(script) // 2) || script AS coin FROM coins)
SELECT count(*) AS coins, count(*) AS said, 'main' AS network, repeat('11', 32) AS base_hash, {_reversed("sha256(unhex(sha256(unhex(string_agg(coin, '' ORDER BY raw_txid, vout)))))")} AS set_hash FROM part_""",
    "snapshot_totals": f"""WITH {SCRIPT_SQL}, {COIN_SQL}
SELECT count(*) AS coins, CAST(sum(sats) AS BIGINT) AS sats, CAST(coalesce(sum(sats) FILTER (visible), 0) AS BIGINT) AS key_in_output, CAST(coalesce(sum(sats) FILTER (hidden), 0) AS BIGINT) AS hash_only,
  CAST(coalesce(sum(sats) FILTER (NOT visible AND NOT hidden), 0) AS BIGINT) AS other, CAST(coalesce(sum(sats) FILTER ((height // 1000 + 1) * 1000 <= tip - 262800), 0) AS BIGINT) AS dormant,
  count(*) FILTER (compact_key AND coinbase) AS coinbase_p2pk_coins, CAST(coalesce(sum(sats) FILTER (compact_key AND coinbase), 0) AS BIGINT) AS coinbase_p2pk, max(tip) AS tip
FROM (SELECT *, max(height) OVER () AS tip FROM coins)""",
    "listed_addresses": PARTY_SQL + "SELECT DISTINCT address, sdn_ref, sdn_name FROM party WHERE good",
    "rejected_addresses": PARTY_SQL + "SELECT DISTINCT address AS value FROM party WHERE NOT good",
    "seed_selection": """WITH s AS (SELECT s_suppkey, 'S' || (s_suppkey % 50) AS address, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_nationkey AS VARCHAR) END AS ref, CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 4 = 0 THEN NULL ELSE s_name END AS name FROM supplier)
SELECT address, coalesce(arg_min(ref, s_suppkey) FILTER (ref IS NOT NULL), '') AS sdn_ref, coalesce(arg_max(name, s_suppkey) FILTER (name IS NOT NULL), '') AS sdn_name FROM s GROUP BY 1""",
    "hash_prefixes": f"WITH {SCRIPT_SQL} SELECT substr(key_hash, 1, 16) AS prefix, count(*) AS coins FROM coin WHERE key_hash IS NOT NULL GROUP BY 1",
}
