"""Registered queries against their SQL on the smallest tables, and streams of new blocks."""

import json
import os
from collections import Counter

import duckdb
import pytest
from chain import seeds, tx

import __spark_entry__ as entry
from ledgerflow.plans import catalog, catalog_sources
from ledgerflow.streaming import increment

DATA = os.environ.get("LEDGERFLOW_DATA", "/root/testdata/sf0.001")
SQL = ["change_labels", "script_types", "utxo_totals", "revealed_bins", "exposure_by_entry", "common_input_clusters", "first_spend", "outflow_total"]
SQL += sorted(catalog_sources.ORACLES)


def plain(frame):
    cell = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
    return sorted(str([cell(v) for v in row]) for row in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", SQL)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    assert plain(entry.queries()[name](spark, DATA).toPandas()) == plain(con.sql(entry.oracle_sql()[name]).df())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_of_blocks(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()

    def arrive(height):
        block = {"hash": f"{height:064d}", "height": height, "time": height * 86400, "tx": [tx(f"t{height}", [("A", 1.0)], [("B", 0.9)])]}
        (folder / f"{height}.json").write_text(json.dumps(block))

    arrive(1)
    increment.extend_ledger(increment.block_stream(spark, str(folder)), str(out), str(tmp_path / "cp")).awaitTermination()
    arrive(2)
    increment.extend_ledger(increment.block_stream(spark, str(folder)), str(out), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["txid"] for r in spark.read.parquet(f"{out}/tx").collect()) == ["t1", "t2"]
    spends = increment.spend_events(increment.block_stream(spark, str(folder)), seeds(spark, "A"))
    query = increment.first_spend_stream(spends).writeStream.outputMode("complete").format("memory").queryName("firsts").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("firsts").first()["first"]["txid"] == "t1"
    windows = increment.spent_by_window(spends).writeStream.outputMode("update").format("memory").queryName("windows").trigger(availableNow=True).start()
    windows.awaitTermination()
    assert spark.table("windows").agg({"inputs": "sum"}).first()[0] == 2


def test_clusters_are_of_all_transactions(spark):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    spends = con.sql(f"WITH {catalog.LEDGER_SQL} SELECT i.txid, address FROM tx_in i JOIN tx USING (txid) JOIN mix USING (txid) WHERE NOT is_coinbase AND NOT coinjoin").fetchall()
    parent = {a: a for _, a in spends}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    first = {}
    for txid, a in spends:
        x, y = sorted((root(a), root(first.setdefault(txid, a))))
        parent[y] = x
    size = Counter(map(root, parent))
    want = sorted((a, root(a), size[root(a)]) for a in parent)
    assert sorted(tuple(r) for r in entry.queries()["common_input_clusters"](spark, DATA).select("address", "cluster", "size").collect()) == want
