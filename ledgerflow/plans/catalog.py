"""The registered ledger queries, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.functions import scripts as S
from ledgerflow.operators import clusters as C
from ledgerflow.operators import exposure as X
from ledgerflow.operators import ledger as L
from ledgerflow.operators import outflow as O
from ledgerflow.operators import trace as T
from ledgerflow.operators import utxo as U
from ledgerflow.session import materialize
from ledgerflow.sources import views as V

ROUND = 3000
NOTHING_FOLLOWED = 10**12
SWEEP = 3

LEDGER_SQL = """
line AS (
  SELECT sha256('o' || l_orderkey) AS txid, l_orderkey, l_returnflag = 'A' AS is_in,
    row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'A' ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1 AS n,
    'P' || l_partkey AS address,
    CASE (l_partkey % 11) % 4 WHEN 0 THEN 'pubkeyhash' WHEN 1 THEN 'scripthash' WHEN 2 THEN 'witness_v0_keyhash' ELSE 'witness_v0_scripthash' END AS type,
    CAST((floor((l_quantity - 1) / 5) + 1) * 1000 AS BIGINT) AS sats
  FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R')),
tx_in AS (SELECT txid, n AS in_index, address, type, sats FROM line WHERE is_in),
tx_out AS (SELECT txid, n, address, type, sats FROM line WHERE NOT is_in),
tx AS (
  SELECT sha256('o' || o_orderkey) AS txid, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS height, o_orderkey AS tx_index,
    CAST(o_orderdate AS DATE) AS day, coalesce(a, 0) = 0 AS is_coinbase, coalesce(a, 0) AS n_in, coalesce(b, 0) AS n_out
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (is_in) AS a, count(*) FILTER (NOT is_in) AS b FROM line GROUP BY 1) ON l_orderkey = o_orderkey),
mix AS (
  SELECT tx.txid, coalesce(k, 0) AS max_equal, coalesce(k, 0) >= 3 AND n_in >= 3 AS coinjoin
  FROM tx LEFT JOIN (SELECT txid, max(c) AS k FROM (SELECT txid, sats, count(*) AS c FROM tx_out GROUP BY ALL) GROUP BY 1) e ON e.txid = tx.txid)"""

CHANGE_SQL = f"""
two AS (
  SELECT o.txid, max(CASE WHEN n = 0 THEN o.address END) AS a, max(CASE WHEN n = 1 THEN o.address END) AS b,
    max(CASE WHEN n = 0 THEN o.type END) AS ta, max(CASE WHEN n = 1 THEN o.type END) AS tb, max(CASE WHEN n = 0 THEN sats END) % {ROUND} = 0 AS ea, max(CASE WHEN n = 1 THEN sats END) % {ROUND} = 0 AS eb
  FROM tx_out o JOIN tx USING (txid) JOIN mix USING (txid) WHERE n_out = 2 AND NOT is_coinbase AND NOT coinjoin GROUP BY o.txid),
paid AS (SELECT txid, count(DISTINCT type) AS types, min(type) AS type, list(DISTINCT address) AS senders FROM tx_in GROUP BY 1),
sig AS (
  SELECT two.txid, list_contains(senders, a) AS ba, list_contains(senders, b) AS bb,
    CAST(types = 1 AND ta = type AND tb <> type AS INT) + CAST(eb AND NOT ea AS INT) AS sa, CAST(types = 1 AND tb = type AND ta <> type AS INT) + CAST(ea AND NOT eb AS INT) AS sb
  FROM two JOIN paid USING (txid)),
guess AS (
  SELECT txid, CASE WHEN ba AND NOT bb THEN 0 WHEN bb AND NOT ba THEN 1 WHEN sa > 0 AND sb = 0 THEN 0 WHEN sb > 0 AND sa = 0 THEN 1 END AS change_n,
    CASE WHEN ba <> bb THEN 1 ELSE sa + sb END AS signals FROM sig),
label AS (
  SELECT o.txid, o.n, o.address, o.sats, CASE WHEN change_n IS NULL THEN 'undetermined' WHEN change_n = o.n THEN 'change (heuristic)' ELSE 'payment (heuristic)' END AS label
  FROM tx_out o JOIN mix USING (txid) LEFT JOIN guess USING (txid) WHERE NOT coinjoin)"""

SCRIPT_SQL = """
script AS (
  SELECT p_partkey, 'P' || p_partkey AS address, CASE p_partkey % 11
    WHEN 0 THEN '76a914' || substr(h, 1, 40) || '88ac' WHEN 1 THEN 'a914' || substr(h, 1, 40) || '87' WHEN 2 THEN '0014' || substr(h, 1, 40)
    WHEN 3 THEN '0020' || h WHEN 4 THEN '5120' || h WHEN 5 THEN '2102' || h || 'ac' WHEN 6 THEN '512102' || h || '2103' || h || '52ae'
    WHEN 7 THEN '51024e73' WHEN 8 THEN '6a20' || h WHEN 9 THEN '5214' || substr(h, 1, 40) ELSE 'ff' || substr(h, 1, 10) END AS script
  FROM (SELECT p_partkey, sha256('s' || p_partkey) AS h FROM (SELECT DISTINCT l_partkey AS p_partkey FROM lineitem UNION SELECT p_partkey FROM part))),
class AS (
  SELECT *, CASE WHEN regexp_full_match(script, '76a914[0-9a-f]{40}88ac') THEN 'pubkeyhash' WHEN regexp_full_match(script, 'a914[0-9a-f]{40}87') THEN 'scripthash'
    WHEN regexp_full_match(script, '0014[0-9a-f]{40}') THEN 'witness_v0_keyhash' WHEN regexp_full_match(script, '0020[0-9a-f]{64}') THEN 'witness_v0_scripthash'
    WHEN regexp_full_match(script, '5120[0-9a-f]{64}') THEN 'witness_v1_taproot' WHEN script = '51024e73' THEN 'anchor'
    WHEN regexp_full_match(script, '(21[0-9a-f]{66}|41[0-9a-f]{130})ac') THEN 'pubkey'
    WHEN regexp_full_match(script, '(5[1-9a-f]|60)(21[0-9a-f]{66}|41[0-9a-f]{130})+(5[1-9a-f]|60)ae') THEN 'multisig'
    WHEN regexp_full_match(script, '6a[0-9a-f]*') THEN 'nulldata'
    WHEN regexp_full_match(script, '(5[2-9a-f]|60)[0-9a-f]{6,}') AND CAST('0x' || substr(script, 3, 2) AS INT) BETWEEN 2 AND 40 AND length(script) = 4 + 2 * CAST('0x' || substr(script, 3, 2) AS INT) THEN 'witness_unknown'
    ELSE 'nonstandard' END AS script_type FROM script),
hashed AS (
  SELECT *, script_type IN ('pubkey', 'multisig', 'witness_v1_taproot') AS visible, script_type IN ('pubkeyhash', 'scripthash', 'witness_v0_keyhash', 'witness_v0_scripthash') AS hidden,
    CASE script_type WHEN 'pubkeyhash' THEN substr(script, 7, 40) WHEN 'scripthash' THEN substr(script, 5, 40) WHEN 'witness_v0_keyhash' THEN substr(script, 5, 40) WHEN 'witness_v0_scripthash' THEN substr(script, 5, 64) END AS key_hash
  FROM class),
spent AS (SELECT DISTINCT key_hash FROM hashed JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'A' AND key_hash IS NOT NULL),
coin AS (
  SELECT address, script, script_type, visible, hidden, hashed.key_hash, spent.key_hash IS NOT NULL AS revealed, l_linestatus = 'F' AS coinbase, CAST(round(l_extendedprice * 100) AS BIGINT) AS sats,
    CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INT) AS height, CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 100) AS INT) AS bin
  FROM lineitem JOIN hashed ON l_partkey = p_partkey LEFT JOIN spent ON spent.key_hash = hashed.key_hash)"""

SEED_SQL = "\nseed AS (SELECT 'P' || p_partkey AS address, p_brand AS sdn_ref, p_type AS sdn_name FROM part WHERE p_partkey % 97 = 0)"

EXPOSURE_SQL = f"""WITH {LEDGER_SQL}, {SCRIPT_SQL}, {SEED_SQL},
bal AS (
  SELECT seed.*, hashed.script_type, visible, hidden, coalesce(s, 0) AS sats, coalesce(k, 0) AS utxos, oldest_height
  FROM seed JOIN hashed USING (address) LEFT JOIN (SELECT script, CAST(sum(sats) AS BIGINT) AS s, count(*) AS k, min(height) AS oldest_height FROM coin GROUP BY 1) c ON c.script = hashed.script),
firsts AS (SELECT address, arg_min(txid, height * 2147483648 + tx_index) AS first_txid, min(height) AS first_height FROM tx_in JOIN tx USING (txid) GROUP BY 1),
expo AS (
  SELECT bal.*, CASE WHEN sats > 0 AND hidden THEN first_txid END AS first_txid, CASE WHEN sats > 0 AND hidden THEN first_height END AS first_height,
    CASE WHEN sats = 0 THEN 'no balance' WHEN visible THEN 'key in output' WHEN hidden AND first_txid IS NOT NULL THEN 'spent before' WHEN hidden THEN 'hash only' ELSE 'not applicable' END AS status
  FROM bal LEFT JOIN firsts USING (address)),
expo2 AS (SELECT *, status IN ('key in output', 'spent before') AS exposed FROM expo)
"""
SUMS_SQL = """count(*) AS addresses, count(*) FILTER (sats > 0) AS funded_addresses, count(*) FILTER (exposed) AS exposed_addresses, CAST(coalesce(sum(sats), 0) AS BIGINT) AS balance,
  CAST(coalesce(sum(sats) FILTER (exposed), 0) AS BIGINT) AS exposed_sats, CAST(coalesce(sum(sats) FILTER (status = 'hash only'), 0) AS BIGINT) AS hash_only"""

# Depth 1 with nothing followed: the sweep test only knows the seeds.
TRACE_SQL = f"""WITH RECURSIVE {LEDGER_SQL}, {CHANGE_SQL}, {SEED_SQL},
sp AS (SELECT i.txid, list_sort(list(DISTINCT i.address)) AS spenders FROM tx_in i JOIN (SELECT DISTINCT address FROM seed) s USING (address) GROUP BY 1),
outside AS (SELECT txid, count(DISTINCT address) AS all_inputs, count(DISTINCT address) FILTER (address NOT IN (SELECT address FROM seed)) AS outside FROM tx_in GROUP BY 1),
info AS (
  SELECT sp.txid, spenders, spenders[1] AS src, day, height, tx_index, n_out, coinjoin, outside >= {SWEEP} AS sweep, NOT coinjoin AND outside >= {SWEEP} AND n_out <= 2 AS stop, outside >= {SWEEP} AND n_out > 2 AS batch
  FROM sp JOIN tx USING (txid) JOIN mix USING (txid) JOIN outside USING (txid)),
traced AS (SELECT i.txid, CAST(sum(sats) AS BIGINT) AS sats FROM tx_in i JOIN info USING (txid) WHERE list_contains(spenders, i.address) GROUP BY 1),
hop AS (SELECT info.txid, src, day, l.n, l.address AS dst, l.sats, l.label FROM info JOIN label l USING (txid) WHERE NOT coinjoin AND NOT stop),
lead AS (SELECT txid, arg_min(address, in_index) AS first FROM tx_in GROUP BY 1),
link AS (
  SELECT first AS a, address AS b, batch FROM tx_in JOIN lead USING (txid) JOIN info USING (txid) WHERE NOT coinjoin AND NOT stop AND first <> address
  UNION ALL SELECT hop.src, dst, batch FROM hop JOIN info USING (txid) WHERE label = 'change (heuristic)'),
pair AS (SELECT DISTINCT a, b, batch FROM (SELECT a, b, batch FROM link UNION ALL SELECT b, a, batch FROM link)),
reach(a, b) AS (SELECT DISTINCT a, a FROM pair UNION SELECT reach.a, pair.b FROM reach JOIN pair ON pair.a = reach.b),
reach2(a, b) AS (SELECT DISTINCT a, a FROM pair WHERE NOT batch UNION SELECT reach2.a, pair.b FROM reach2 JOIN pair ON pair.a = reach2.b WHERE NOT batch),
full_ AS (SELECT a AS address, min(b) AS root FROM reach GROUP BY 1 UNION SELECT address, address FROM seed WHERE address NOT IN (SELECT a FROM pair)),
core_ AS (SELECT a AS address, min(b) AS root FROM reach2 GROUP BY 1),
flow AS (
  SELECT 'hop' AS kind, txid, day, sats, src, dst FROM hop
  UNION ALL SELECT 'sweep', txid, day, t.sats, src, o.address FROM info JOIN traced t USING (txid) LEFT JOIN tx_out o USING (txid) WHERE stop
  UNION ALL SELECT 'mix', txid, day, t.sats, src, NULL FROM info JOIN traced t USING (txid) WHERE coinjoin),
ends AS (
  SELECT f.*, sf.root AS src_full, sc.root AS src_core, df.root AS dst_full, dc.root AS dst_core,
    src = dst OR coalesce(sf.root = df.root, false) AS same_full, src = dst OR coalesce(sc.root = dc.root, false) AS same_core
  FROM flow f LEFT JOIN full_ sf ON sf.address = src LEFT JOIN core_ sc ON sc.address = src LEFT JOIN full_ df ON df.address = dst LEFT JOIN core_ dc ON dc.address = dst)"""

ENTITY_SQL = """,
ent AS (SELECT DISTINCT sdn_ref, address FROM seed),
ent_full AS (SELECT DISTINCT sdn_ref, root FROM ent JOIN full_ USING (address)),
ent_core AS (SELECT DISTINCT sdn_ref, root FROM ent JOIN core_ USING (address)),
ef AS (
  SELECT e.sdn_ref, kind, txid, day, sats, n, coalesce(bool_or(i.root IS NOT NULL), false) AS in_low,
    coalesce(bool_or(dst IS NOT NULL AND (o.address IS NOT NULL OR same_core OR c.root IS NOT NULL)), false) AS in_high
  FROM (SELECT *, CASE WHEN kind = 'hop' THEN row_number() OVER () ELSE 0 END AS n FROM ends) x JOIN ent_full e ON e.root = src_full
  LEFT JOIN ent_full i ON i.sdn_ref = e.sdn_ref AND i.root = dst_full LEFT JOIN ent_core c ON c.sdn_ref = e.sdn_ref AND c.root = dst_core
  LEFT JOIN ent o ON o.sdn_ref = e.sdn_ref AND o.address = dst GROUP BY e.sdn_ref, kind, txid, day, sats, n)"""


def _trace1(spark, d):
    """Depth 1, a floor above every output, sweeps at SWEEP strangers; with memberships."""
    found = T.trace(L.stored(V.ledger(spark, d)), V.seeds(spark, d), max_depth=1, max_addresses=None, min_sats=NOTHING_FOLLOWED, service_min_inputs=SWEEP, round_unit=ROUND)
    full, core = C.two_views(found.links, found.seeds)
    return found, full, core


def _trace2(spark, d):
    return T.trace(L.stored(V.ledger(spark, d)), V.seeds(spark, d), max_depth=2, max_addresses=None, service_min_inputs=0, round_unit=ROUND)


def _marked(spark, d):
    return U.with_revealed(U.classified(V.utxo(spark, d), V.BIN_DAYS), V.revealed(spark, d))


def _expo(spark, d):
    s = V.seeds(spark, d)
    return X.exposure(V.addresses(spark, d).join(s.select("address"), "address", "left_semi"), V.utxo(spark, d), V.ledger(spark, d), s)


def _info(spark, d):
    return V.seeds(spark, d).select("address", "sdn_ref", "sdn_name")


def change_labels(spark, d):
    ledger = V.ledger(spark, d)
    return L.change_guesses(ledger, ROUND).select("txid", F.col("change_n").cast("long").alias("change_n"), F.size("reasons").cast("long").alias("signals"))


def output_label_counts(spark, d):
    return L.output_labels(V.ledger(spark, d), ROUND).groupBy("label").agg(F.count("*").alias("outputs"), F.sum("sats").alias("sats"))


def utxo_totals(spark, d):
    return U.totals(_marked(spark, d), V.BIN_DAYS, V.DORMANT_DAYS)


def yearly_exposure(spark, d):
    dates = spark.range(0, 20000).select(F.col("id").cast("int").alias("height"), F.date_add(F.lit(V.EPOCH).cast("date"), F.col("id").cast("int")).alias("date"))
    return U.yearly_exposure(_marked(spark, d), dates, V.BIN_DAYS)


def spends_from_frontier(spark, d):
    frontier = V.seeds(spark, d).select("address", F.lit(100).alias("reached"))
    return T.spends_of(V.ledger(spark, d), frontier).select("txid", "height", F.size("spenders").cast("long").alias("spenders"), F.col("spenders")[0].alias("first"))


def hops(depth):
    def query(spark, d):
        return _trace2(spark, d).hops.where(F.col("depth") == depth).select("txid", F.col("n").cast("long").alias("n"), "address", "sats", "label", "followed")

    return query


def level_stats(spark, d):
    rows = [(x["depth"], x["addresses"], x["scanned_from_height"], x["blocks_touching"], x["spending_txs"]) for x in _trace2(spark, d).levels]
    return spark.createDataFrame(rows, "depth int, addresses long, scanned_from_height int, blocks_touching long, spending_txs long")


def seed_summary(spark, d):
    found, _, _ = _trace1(spark, d)
    return T.seed_summaries(found).fillna(-1, ["first_spend_height", "last_spend_height"]).select("address", "spending_txs", "spent", "returned", "net_out", "first_spend_height", "last_spend_height")


def cluster_summary(spark, d):
    found, full, core = _trace1(spark, d)
    return C.clusters(found.links, found.seeds, full, core).select("full", "addresses", "seeds", "size_without_batch_sweeps")


def cluster_outflow(spark, d):
    found, full, core = _trace1(spark, d)
    listed = materialize(C.clusters(found.links, found.seeds, full, core), "clusters")
    out = O.cluster_outflow(found, listed, full, core)
    return out.join(listed.select("cluster", "full").hint("merge"), "cluster").select("full", "seeds", *O.MEASURES, "spending_txs")


def outflow_total(spark, d):
    found, full, core = _trace1(spark, d)
    listed = materialize(C.clusters(found.links, found.seeds, full, core), "clusters")
    return O.outflow_total(O.cluster_outflow(found, listed, full, core))


def entity_outflow(spark, d):
    found, full, core = _trace1(spark, d)
    return O.entity_outflow(found, _info(spark, d), full, core)


def entity_month(spark, d):
    found, full, core = _trace1(spark, d)
    return O.entity_months(found, _info(spark, d), full, core)


def top_destinations(spark, d):
    found, _, _ = _trace1(spark, d)
    return O.top_destinations(found).select("address", F.round("sats", 3).alias("sats"))


def full_trace(spark, d):
    """Three levels with sweeps and a cap, as hops: the order within a level matters."""
    found = T.trace(L.stored(V.ledger(spark, d)), V.seeds(spark, d), max_depth=3, max_addresses=400, min_sats=2000, service_min_inputs=SWEEP, round_unit=ROUND)
    return found.hops.select("depth", "txid", "n", "address", "sats", "label", "followed")


def exposure_status(spark, d):
    return _expo(spark, d).fillna(-1, ["oldest_height", "first_height"]).select("address", "script_type", "sats", "utxos", "oldest_height", "status", "exposed", "first_txid", "first_height", "sdn_ref")


QUERIES = {
    "coinjoin_flags": lambda s, d: L.coinjoin_flags(V.ledger(s, d)),
    "change_labels": change_labels,
    "output_label_counts": output_label_counts,
    "input_value_by_address": lambda s, d: L.input_value_by_address(V.ledger(s, d)),
    "tx_input_counts": lambda s, d: L.input_counts(V.ledger(s, d)),
    "script_types": lambda s, d: V.addresses(s, d).withColumn("script_type", S.script_type(F.col("script"))).withColumn("label", S.label(F.col("script_type"))).select("address", "script_type", "label"),
    "utxo_by_type": lambda s, d: U.by_type(U.classified(V.utxo(s, d), V.BIN_DAYS)),
    "utxo_age_bins": lambda s, d: U.by_type_and_bin(U.classified(V.utxo(s, d), V.BIN_DAYS)),
    "utxo_totals": utxo_totals,
    "hash_targets": lambda s, d: U.hash_targets(U.classified(V.utxo(s, d), V.BIN_DAYS)).select(F.lower(F.hex("key_hash")).alias("key_hash")),
    "revealed_by_type": lambda s, d: U.revealed_by_type(_marked(s, d)),
    "revealed_bins": lambda s, d: U.revealed_bins(_marked(s, d)),
    "yearly_exposure": yearly_exposure,
    "address_balance": lambda s, d: X.balances(V.addresses(s, d), V.utxo(s, d)).fillna(-1, ["oldest_height"]).select("address", "sats", "utxos", "oldest_height"),
    "first_spend": lambda s, d: X.first_spends(V.ledger(s, d), V.addresses(s, d)).select("address", "first_height", "first_txid"),
    "exposure_status": exposure_status,
    "exposure_totals": lambda s, d: X.exposure_totals(_expo(s, d)).withColumnRenamed("exposed", "exposed_sats"),
    "exposure_by_type": lambda s, d: X.exposure_by_type(_expo(s, d)).withColumnRenamed("exposed", "exposed_sats"),
    "exposure_by_entry": lambda s, d: X.exposure_by_entry(_expo(s, d)).withColumnRenamed("exposed", "exposed_sats"),
    "common_input_clusters": lambda s, d: C.common_input_clusters(V.ledger(s, d)),
    "spends_from_frontier": spends_from_frontier,
    "level_stats": level_stats,
    "hops_depth1": hops(1),
    "hops_depth2": hops(2),
    "seed_summary": seed_summary,
    "cluster_summary": cluster_summary,
    "cluster_outflow": cluster_outflow,
    "outflow_total": outflow_total,
    "entity_outflow": entity_outflow,
    "entity_month": entity_month,
    "top_destinations": top_destinations,
    "full_trace": full_trace,
}


def _w(sql: str, *parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + sql


HOPS2_SQL = f"""WITH {LEDGER_SQL}, {CHANGE_SQL}, {SEED_SQL},
t1 AS (SELECT DISTINCT i.txid FROM tx_in i JOIN seed USING (address)),
h1 AS (SELECT l.*, height * 2147483648 + tx_index AS ord, height FROM label l JOIN t1 USING (txid) JOIN tx USING (txid)),
r1 AS (SELECT address, min(ord * 1000 + n) AS at, arg_min(height, ord * 1000 + n) AS reached FROM h1 WHERE address NOT IN (SELECT address FROM seed) GROUP BY 1),
hop1 AS (SELECT h1.*, coalesce(ord * 1000 + n = r1.at, false) AS followed FROM h1 LEFT JOIN r1 USING (address)),
s2 AS (SELECT i.txid, min(reached) AS reached FROM tx_in i JOIN r1 USING (address) GROUP BY 1),
p2 AS (SELECT s2.txid FROM s2 JOIN tx USING (txid) WHERE height >= reached),
t2 AS (SELECT txid FROM p2 WHERE txid NOT IN (SELECT txid FROM t1)),
h2 AS (SELECT l.*, height * 2147483648 + tx_index AS ord, height FROM label l JOIN t2 USING (txid) JOIN tx USING (txid)),
r2 AS (SELECT address, min(ord * 1000 + n) AS at FROM h2 WHERE address NOT IN (SELECT address FROM seed) AND address NOT IN (SELECT address FROM r1) GROUP BY 1),
hop2 AS (SELECT h2.*, coalesce(ord * 1000 + n = r2.at, false) AS followed FROM h2 LEFT JOIN r2 USING (address)),
side AS (SELECT txid, address FROM tx_in UNION SELECT txid, address FROM tx_out)
"""

ORACLES = {
    "coinjoin_flags": _w("SELECT txid, max_equal, coinjoin FROM mix", LEDGER_SQL),
    "change_labels": _w("SELECT txid, CAST(change_n AS BIGINT) AS change_n, CAST(signals AS BIGINT) AS signals FROM guess WHERE change_n IS NOT NULL", LEDGER_SQL, CHANGE_SQL),
    "output_label_counts": _w("SELECT label, count(*) AS outputs, CAST(sum(sats) AS BIGINT) AS sats FROM label GROUP BY 1", LEDGER_SQL, CHANGE_SQL),
    "input_value_by_address": _w("SELECT txid, address, CAST(sum(sats) AS BIGINT) AS sats FROM tx_in GROUP BY 1, 2", LEDGER_SQL),
    "tx_input_counts": _w("SELECT txid, address, count(*) AS inputs, CAST(min(in_index) AS INT) AS first_index FROM tx_in GROUP BY 1, 2", LEDGER_SQL),
    "script_types": _w(
        "SELECT address, script_type, CASE script_type WHEN 'pubkey' THEN 'P2PK' WHEN 'multisig' THEN 'bare multisig' WHEN 'pubkeyhash' THEN 'P2PKH' WHEN 'scripthash' THEN 'P2SH' "
        "WHEN 'witness_v0_keyhash' THEN 'P2WPKH' WHEN 'witness_v0_scripthash' THEN 'P2WSH' WHEN 'witness_v1_taproot' THEN 'P2TR (Taproot)' WHEN 'nulldata' THEN 'OP_RETURN' "
        "WHEN 'witness_unknown' THEN 'future witness version' ELSE script_type END AS label FROM class WHERE p_partkey IN (SELECT p_partkey FROM part)",
        SCRIPT_SQL,
    ),
    "utxo_by_type": _w("SELECT script_type, count(*) AS coins, CAST(sum(sats) AS BIGINT) AS sats FROM coin GROUP BY 1", SCRIPT_SQL),
    "utxo_age_bins": _w("SELECT script_type, bin, count(*) AS coins, CAST(sum(sats) AS BIGINT) AS sats FROM coin GROUP BY 1, 2", SCRIPT_SQL),
    "utxo_totals": _w(
        """SELECT count(*) AS coins, CAST(sum(sats) AS BIGINT) AS sats, CAST(sum(sats) FILTER (visible) AS BIGINT) AS key_in_output, CAST(sum(sats) FILTER (hidden) AS BIGINT) AS hash_only,
  CAST(sum(sats) FILTER (NOT visible AND NOT hidden) AS BIGINT) AS other, CAST(coalesce(sum(sats) FILTER (revealed), 0) AS BIGINT) AS revealed, CAST(coalesce(sum(sats) FILTER (visible OR revealed), 0) AS BIGINT) AS exposed,
  CAST(coalesce(sum(sats) FILTER (old), 0) AS BIGINT) AS dormant, CAST(coalesce(sum(sats) FILTER (old AND visible), 0) AS BIGINT) AS dormant_key_in_output,
  CAST(coalesce(sum(sats) FILTER (old AND (visible OR revealed)), 0) AS BIGINT) AS dormant_exposed, count(*) FILTER (script_type = 'pubkey' AND coinbase) AS coinbase_p2pk_coins,
  CAST(coalesce(sum(sats) FILTER (script_type = 'pubkey' AND coinbase), 0) AS BIGINT) AS coinbase_p2pk, max(tip) AS tip
FROM (SELECT *, (bin + 1) * 100 <= tip - 365 AS old FROM (SELECT *, max(height) OVER () AS tip FROM coin))""",
        SCRIPT_SQL,
    ),
    "hash_targets": _w("SELECT DISTINCT key_hash FROM coin WHERE key_hash IS NOT NULL", SCRIPT_SQL),
    "revealed_by_type": _w("SELECT script_type, count(*) FILTER (revealed) AS coins, CAST(coalesce(sum(sats) FILTER (revealed), 0) AS BIGINT) AS sats FROM coin WHERE hidden GROUP BY 1", SCRIPT_SQL),
    "revealed_bins": _w("SELECT script_type, bin, count(*) AS coins, CAST(sum(sats) AS BIGINT) AS sats FROM coin WHERE revealed GROUP BY 1, 2", SCRIPT_SQL),
    "yearly_exposure": _w(
        """SELECT strftime(DATE '1995-01-01' + bin * 100, '%Y') AS year, CAST(coalesce(sum(sats) FILTER (visible), 0) AS BIGINT) AS key_visible, CAST(coalesce(sum(sats) FILTER (revealed), 0) AS BIGINT) AS revealed,
  CAST(coalesce(sum(sats) FILTER (hidden AND NOT revealed), 0) AS BIGINT) AS hidden, CAST(coalesce(sum(sats) FILTER (NOT visible AND NOT hidden), 0) AS BIGINT) AS other FROM coin GROUP BY 1""",
        SCRIPT_SQL,
    ),
    "address_balance": _w(
        "SELECT h.address, coalesce(s, 0) AS sats, coalesce(k, 0) AS utxos, coalesce(oldest_height, -1) AS oldest_height FROM hashed h LEFT JOIN (SELECT script, CAST(sum(sats) AS BIGINT) AS s, count(*) AS k, min(height) AS oldest_height FROM coin GROUP BY 1) c USING (script) WHERE p_partkey IN (SELECT p_partkey FROM part)",
        SCRIPT_SQL,
    ),
    "first_spend": _w(
        "SELECT address, min(height) AS first_height, arg_min(txid, height * 2147483648 + tx_index) AS first_txid FROM tx_in JOIN tx USING (txid) WHERE address IN (SELECT 'P' || p_partkey FROM part) GROUP BY 1", LEDGER_SQL
    ),
    "exposure_status": EXPOSURE_SQL + "SELECT address, script_type, sats, utxos, coalesce(oldest_height, -1) AS oldest_height, status, exposed, first_txid, coalesce(first_height, -1) AS first_height, sdn_ref FROM expo2",
    "exposure_totals": EXPOSURE_SQL + f"SELECT {SUMS_SQL} FROM expo2",
    "exposure_by_type": EXPOSURE_SQL + f"SELECT script_type, {SUMS_SQL} FROM expo2 GROUP BY 1",
    "exposure_by_entry": EXPOSURE_SQL + f"SELECT sdn_ref, {SUMS_SQL}, min(sdn_name) AS sdn_name FROM expo2 GROUP BY 1",
    "common_input_clusters": f"""WITH RECURSIVE {LEDGER_SQL},
plain AS (SELECT i.* FROM tx_in i JOIN tx USING (txid) JOIN mix USING (txid) WHERE NOT is_coinbase AND NOT coinjoin),
lead AS (SELECT txid, arg_min(address, in_index) AS first FROM plain GROUP BY 1),
edge AS (SELECT DISTINCT first AS a, address AS b FROM plain JOIN lead USING (txid)),
both_ AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
least_(address, cluster) USING KEY (address) AS (
  SELECT a, a FROM both_ UNION
  SELECT b, min(x.cluster) FROM (SELECT both_.b, n.cluster FROM least_ n JOIN both_ ON both_.a = n.address) x JOIN recurring.least_ k ON k.address = b WHERE x.cluster < k.cluster GROUP BY b)
SELECT address, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM least_""",
    "spends_from_frontier": _w(
        "SELECT txid, height, count(DISTINCT address) AS spenders, min(address) AS first FROM tx_in JOIN tx USING (txid) WHERE height >= 100 AND address IN (SELECT address FROM seed) GROUP BY 1, 2", LEDGER_SQL, SEED_SQL
    ),
    "hops_depth1": HOPS2_SQL + "SELECT txid, n, address, sats, label, followed FROM hop1",
    "hops_depth2": HOPS2_SQL + "SELECT txid, n, address, sats, label, followed FROM hop2",
    "level_stats": HOPS2_SQL
    + """SELECT 1 AS depth, (SELECT count(DISTINCT address) FROM seed) AS addresses, 0 AS scanned_from_height,
  (SELECT count(DISTINCT height) FROM side JOIN tx USING (txid) WHERE address IN (SELECT address FROM seed)) AS blocks_touching, (SELECT count(*) FROM t1) AS spending_txs
UNION ALL SELECT 2, (SELECT count(*) FROM r1), (SELECT min(reached) FROM r1), (SELECT count(DISTINCT height) FROM side JOIN tx USING (txid) WHERE address IN (SELECT address FROM r1) AND height >= (SELECT min(reached) FROM r1)), (SELECT count(*) FROM p2)""",
    "seed_summary": TRACE_SQL
    + """, act AS (SELECT s.address, i.txid, height, height * 2147483648 + tx_index AS ord, (SELECT sum(sats) FROM tx_in x WHERE x.txid = i.txid AND x.address = s.address) AS sats,
  coalesce((SELECT sum(sats) FROM tx_out x WHERE x.txid = i.txid AND x.address = s.address), 0) AS back FROM (SELECT DISTINCT address FROM seed) s JOIN info i ON list_contains(spenders, s.address))
SELECT s.address, count(txid) AS spending_txs, CAST(coalesce(sum(sats), 0) AS BIGINT) AS spent, CAST(coalesce(sum(back), 0) AS BIGINT) AS returned, CAST(coalesce(sum(sats - back), 0) AS BIGINT) AS net_out,
  coalesce(arg_min(height, ord), -1) AS first_spend_height, coalesce(arg_max(height, ord), -1) AS last_spend_height FROM (SELECT DISTINCT address FROM seed) s LEFT JOIN act USING (address) GROUP BY 1""",
    "cluster_summary": TRACE_SQL
    + """, cs AS (SELECT root, count(*) AS k FROM core_ GROUP BY 1), m AS (SELECT f.root, f.address, coalesce(k, 1) AS k, f.address IN (SELECT address FROM seed) AS is_seed FROM full_ f LEFT JOIN core_ c USING (address) LEFT JOIN cs ON cs.root = c.root)
SELECT root AS "full", count(*) AS addresses, count(*) FILTER (is_seed) AS seeds, coalesce(max(k) FILTER (is_seed), max(k)) AS size_without_batch_sweeps FROM m GROUP BY 1 HAVING count(*) > 1 OR bool_or(is_seed)""",
    "cluster_outflow": TRACE_SQL
    + """, sz AS (SELECT root, count(*) AS k, count(*) FILTER (address IN (SELECT address FROM seed)) AS seeds FROM full_ GROUP BY 1 HAVING count(*) > 1 OR bool_or(address IN (SELECT address FROM seed))),
judge AS (SELECT txid, bool_or(s = d OR coalesce(sf.root = df.root, false)) AS internal, bool_or(s = d OR coalesce(sc.root = dc.root, false)) AS internal_core
  FROM (SELECT txid, unnest(spenders) AS s FROM info WHERE stop) JOIN (SELECT txid, address AS d FROM tx_out) USING (txid)
  LEFT JOIN full_ sf ON sf.address = s LEFT JOIN core_ sc ON sc.address = s LEFT JOIN full_ df ON df.address = d LEFT JOIN core_ dc ON dc.address = d GROUP BY 1),
hopsum AS (SELECT src_full AS root, sum(sats) FILTER (NOT same_full) AS a, sum(sats) FILTER (NOT same_core) AS b, sum(sats) FILTER (NOT same_full AND dst_full IN (SELECT root FROM sz WHERE seeds > 0)) AS c FROM ends WHERE kind = 'hop' GROUP BY 1),
rest AS (SELECT DISTINCT kind, txid, sats, src_full AS root FROM ends WHERE kind <> 'hop'),
restsum AS (SELECT root, sum(sats) FILTER (kind = 'sweep' AND NOT coalesce(internal, false)) AS d, sum(sats) FILTER (kind = 'sweep' AND NOT coalesce(internal_core, false)) AS e, sum(sats) FILTER (kind = 'mix') AS f FROM rest LEFT JOIN judge USING (txid) GROUP BY 1)
SELECT sz.root AS "full", seeds, CAST(coalesce(a, 0) AS BIGINT) AS to_outside_addresses, CAST(coalesce(b, 0) AS BIGINT) AS to_outside_addresses_core, CAST(coalesce(c, 0) AS BIGINT) AS to_other_seed_clusters,
  CAST(coalesce(d, 0) AS BIGINT) AS into_service_sweeps, CAST(coalesce(e, 0) AS BIGINT) AS into_service_sweeps_core, CAST(coalesce(f, 0) AS BIGINT) AS into_coinjoins, t AS spending_txs
FROM sz JOIN (SELECT src_full AS root, count(DISTINCT txid) AS t FROM ends GROUP BY 1) USING (root) LEFT JOIN hopsum USING (root) LEFT JOIN restsum USING (root)""",
    "entity_outflow": TRACE_SQL
    + ENTITY_SQL
    + """, s AS (SELECT sdn_ref, sum(sats) FILTER (kind = 'hop' AND NOT in_low) AS a, sum(sats) FILTER (kind = 'hop' AND NOT in_high) AS b, sum(sats) FILTER (kind = 'sweep' AND NOT in_low) AS c,
  sum(sats) FILTER (kind = 'sweep' AND NOT in_high) AS d, sum(sats) FILTER (kind = 'mix') AS e, count(DISTINCT txid) AS t FROM ef GROUP BY 1)
SELECT sdn_ref, seeds, clusters, CAST(cluster_addresses AS BIGINT) AS cluster_addresses, CAST(coalesce(a, 0) AS BIGINT) AS to_outside_addresses, CAST(coalesce(b, 0) AS BIGINT) AS to_outside_addresses_core,
  CAST(coalesce(c, 0) AS BIGINT) AS into_service_sweeps, CAST(coalesce(d, 0) AS BIGINT) AS into_service_sweeps_core, CAST(coalesce(e, 0) AS BIGINT) AS into_coinjoins, coalesce(t, 0) AS spending_txs
FROM (SELECT sdn_ref, count(DISTINCT address) AS seeds, count(DISTINCT root) AS clusters FROM ent JOIN full_ USING (address) GROUP BY 1)
JOIN (SELECT sdn_ref, sum(k) AS cluster_addresses FROM ent_full JOIN (SELECT root, count(*) AS k FROM full_ GROUP BY 1) USING (root) GROUP BY 1) USING (sdn_ref) LEFT JOIN s USING (sdn_ref)""",
    "entity_month": TRACE_SQL
    + ENTITY_SQL
    + """ SELECT sdn_ref, strftime(day, '%Y-%m') AS month, CAST(coalesce(sum(sats) FILTER (kind = 'mix' OR NOT in_low), 0) AS BIGINT) AS low, CAST(coalesce(sum(sats) FILTER (kind = 'mix' OR NOT in_high), 0) AS BIGINT) AS high FROM ef GROUP BY 1, 2""",
    "top_destinations": TRACE_SQL
    + """ SELECT address, round(sum(t.sats / n_out), 3) AS sats FROM info JOIN traced t USING (txid) JOIN tx_out o USING (txid) WHERE stop GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
}

ORACLES["outflow_total"] = f"""WITH flows_ AS ({ORACLES["cluster_outflow"]})
SELECT {", ".join(f"CAST(coalesce(sum({m}), 0) AS BIGINT) AS {m}" for m in (*O.MEASURES, "spending_txs"))},
  CAST(coalesce(sum(to_outside_addresses + into_service_sweeps + into_coinjoins), 0) AS BIGINT) AS total,
  CAST(coalesce(sum(to_outside_addresses_core + into_service_sweeps_core + into_coinjoins), 0) AS BIGINT) AS total_core FROM flows_ WHERE seeds > 0"""
