import random

from chain import coinbase, ledger, seeds, tx

from ledgerflow.operators import clusters as C
from ledgerflow.operators import ledger as L
from ledgerflow.operators import outflow as O
from ledgerflow.operators import trace as T
from ledgerflow.operators.graph import connected_components
from ledgerflow.plans import catalog, render, reports
from ledgerflow.sources import views as V

PKH = "pubkeyhash"
LINEAR = {
    50: [tx("fund", [("F", 1.0)], [("S", 1.0)])],
    100: [tx("t1", [("S", 1.0)], [("P1", 0.5, PKH), ("C1", 0.49871234)])],
    105: [tx("t2", [("P1", 0.5, PKH)], [("Q", 0.4999, PKH)])],
    106: [tx("mix", [("C1", 0.49871234), ("M1", 0.1), ("M2", 0.1)], [("O1", 0.1), ("O2", 0.1), ("O3", 0.1), ("O4", 0.3)])],
    110: [tx("t3", [("Q", 0.4999, PKH)], [("R", 0.4998), ("D", 0.00001)])],
    120: [tx("other", [("U", 1.0)], [("V", 1.0)])],
}


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_labels_and_mixes(spark, tmp_path):
    chain = ledger(
        spark,
        tmp_path,
        {
            1: [coinbase("cb", [("A", 50.0)]), tx("reuse", [("A", 3.0)], [("B", 1.5), ("A", 1.49)])],
            2: [tx("both", [("A", 3.0)], [("B", 1.0, PKH), ("X", 1.99123456)])],
            3: [tx("apart", [("A", 3.0)], [("B", 1.0), ("X", 1.99123456, PKH)])],
            4: [tx("one", [("A", 3.0)], [("B", 1.0)]), tx("data", [("A", 3.0)], [("B", 1.23456789), (None, 0.0)])],
            5: [tx("batch", [("A", 9.0)], [("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", 1.0)])],
            6: [tx("mix", [("A", 1.0), ("B", 1.0), ("C", 1.0)], [("a", 0.9), ("b", 0.9), ("c", 0.9)])],
        },
    )
    guess = {r["txid"]: (r["change_n"], len(r["reasons"])) for r in L.change_guesses(chain).collect()}
    assert guess == {"reuse": (1, 1), "both": (1, 2), "data": (0, 2)}
    assert [r["txid"] for r in L.coinjoin_flags(chain).where("coinjoin").collect()] == ["mix"]
    labels = {(r["txid"], r["n"]): r["label"] for r in L.output_labels(chain).collect()}
    assert labels[("reuse", 0)] == L.PAYMENT and labels[("apart", 1)] == L.UNDETERMINED and ("mix", 0) not in labels


def test_clusters_of_common_inputs(spark, tmp_path):
    chain = ledger(spark, tmp_path, {1: [tx("a", [("A", 1.0), ("B", 1.0)], [("x", 2.0)]), tx("b", [("B", 1.0), ("C", 1.0)], [("y", 2.0)]), tx("c", [("D", 1.0)], [("z", 1.0)]), coinbase("cb", [("E", 50.0)])]})
    assert rows(C.common_input_clusters(chain), "address", "cluster", "size") == [("A", "A", 3), ("B", "A", 3), ("C", "A", 3), ("D", "D", 1)]


def test_trace_follows_levels(spark, tmp_path):
    chain = ledger(spark, tmp_path, LINEAR)
    one = T.trace(chain, seeds(spark, "S"), max_depth=1)
    assert rows(one.hops, "address", "label") == [("C1", L.CHANGE), ("P1", L.PAYMENT)]
    assert rows(one.unexplored, "address") == [("C1",), ("P1",)]
    assert one.tip == 120
    three = T.trace(chain, seeds(spark, "S"), max_depth=3, min_sats=100_000)
    assert {(r["address"], r["depth"], r["followed"]) for r in three.hops.collect()} == {("P1", 1, True), ("C1", 1, True), ("Q", 2, True), ("R", 3, True), ("D", 3, False)}
    assert rows(three.coinjoin_stops, "txid", "spenders", "traced_sats") == [("mix", ["C1"], 49871234)]
    assert [(x["addresses"], x["scanned_from_height"], x["spending_txs"]) for x in three.levels] == [(1, 0, 1), (2, 100, 2), (1, 105, 1)]


def test_trace_cap(spark, tmp_path):
    found = T.trace(ledger(spark, tmp_path, LINEAR), seeds(spark, "S"), max_depth=1, max_addresses=2)
    assert found.truncated and found.hops.where("followed").count() == 1


def test_sweep_ends_a_branch_and_report_is_valid(spark, tmp_path):
    strangers = [(f"O{i}", 1.0) for i in range(25)]
    chain = ledger(
        spark,
        tmp_path,
        {
            100: [tx("t1", [("S", 100.0), ("A1", 50.0), ("A2", 25.0)], [("C1", 30.0, PKH), ("X1", 140.1419)])],
            110: [tx("t2", [("X1", 140.1419), *strangers], [("H", 165.0)])],
            120: [tx("t3", [("C1", 30.0, PKH), ("B1", 5.0, PKH)], [("C2", 3.123, PKH), ("X2", 31.0)])],
        },
    )
    found = T.trace(chain, seeds(spark, "S"), max_depth=3)
    assert rows(found.service_stops, "txid", "spenders", "outside", "traced_sats") == [("t2", ["X1"], 25, 14014190000)]
    assert "H" not in {r["address"] for r in found.hops.collect()}
    info = spark.createDataFrame([("S", "100", "ENTRY")], "address string, sdn_ref string, sdn_name string")
    report = reports.trace_report(found, info)
    assert reports.validate(report) == []
    assert report["service_stops"][0]["classification"] == reports.SERVICE and report["seed_summaries"][0]["sdn_name"] == "ENTRY"
    assert "<svg" in render.trace_page(report)
    report["hops"][0]["value_btc"] = -1
    report["extra"] = 1
    assert any("hops[0].value_btc" in p for p in reports.validate(report)) and any("'extra'" in p for p in reports.validate(report))
    loose = T.trace(chain, seeds(spark, "X1"), max_depth=1, service_min_inputs=0)
    assert "H" in {r["address"] for r in loose.hops.collect()}


def test_outflow_low_and_high(spark, tmp_path):
    many = [(f"D{i}", 0.1) for i in range(25)]
    chain = ledger(
        spark,
        tmp_path,
        {
            10: [tx("t1", [("S", 1.0), ("W", 1.0)], [("C", 1.9)])],
            11: [tx("t2", [("S", 0.25), *many], [("W", 2.0)])],
            12: [tx("t3", [("S", 0.25), *[(f"E{i}", 0.1) for i in range(25)]], [("H", 2.0)])],
            13: [tx("t4", [("S", 0.375), *[(f"B{i}", 0.1) for i in range(25)]], [("x", 1.0), ("y", 1.0), ("z", 0.5)])],
            14: [tx("t5", [("T", 3.0)], [("Q", 2.99)])],
        },
    )
    found = T.trace(chain, seeds(spark, "S", "T"), max_depth=1)
    full, core = C.two_views(found.links, found.seeds)
    listed = {r["seeds"]: r for r in C.clusters(found.links, found.seeds, full, core).where("addresses > 1").collect()}
    assert (listed[1]["addresses"], listed[1]["batch_links"], listed[1]["size_without_batch_sweeps"]) == (27, 1, 2)
    judged = {r["txid"]: r["internal"] for r in O.classify_sweeps(found, full, core).collect()}
    assert judged == {"t2": True, "t3": False}
    by_seed = {r["address"]: (r["spending_txs"], r["spent"], str(r["first_spend"]), str(r["last_spend"])) for r in T.seed_summaries(found).collect()}
    assert by_seed["S"] == (4, 187_500_000, "2020-01-11", "2020-01-14") and by_seed["T"][:2] == (1, 300_000_000)
    info = spark.createDataFrame([("S", "1", "ONE"), ("T", "1", "ONE")], "address string, sdn_ref string, sdn_name string")
    entity = O.entity_outflow(found, info, full, core).first()
    months = O.entity_months(found, info, full, core).collect()
    assert entity["into_service_sweeps"] == 25_000_000 and entity["seeds"] == 2
    assert sum(m["low"] for m in months) == entity["to_outside_addresses"] + entity["into_service_sweeps"] + entity["into_coinjoins"]


def sequential(blocks, seed_list, depth, cap, floor, least):
    """A plain model of the trace: hops and sweeps, in order."""
    visited, frontier, seen, hops, stops = set(seed_list), dict.fromkeys(seed_list, 0), set(), [], []
    for level in range(1, depth + 1):
        following = {}
        for height in sorted(blocks):
            for t in blocks[height]:
                addresses = list(dict.fromkeys(v["prevout"]["scriptPubKey"]["address"] for v in t["vin"]))
                spenders = [a for a in addresses if a in frontier]
                if not spenders or height < min(frontier[a] for a in spenders) or t["txid"] in seen:
                    continue
                seen.add(t["txid"])
                outside = [a for a in addresses if a not in visited]
                if least and len(outside) >= least and len(t["vout"]) <= 2:
                    stops.append((level, t["txid"], len(outside)))
                    continue
                for o in t["vout"]:
                    a = o["scriptPubKey"]["address"]
                    follow = round(o["value"] * 1e8) >= floor and a not in visited and len(visited) < cap
                    if follow:
                        visited.add(a)
                        following[a] = height
                    hops.append((level, t["txid"], o["n"], a, follow))
        frontier = following
    return sorted(hops), sorted(stops)


def test_trace_agrees_with_a_sequential_model(spark, tmp_path):
    rng = random.Random(1)
    name = lambda: f"a{rng.randrange(60)}"
    blocks = {}
    for i in range(120):
        ins = [(a, 1.0) for a in dict.fromkeys(name() for _ in range(rng.randrange(1, 5)))]
        outs = [(name(), rng.randrange(1, 90) / 100 + i * 1e-8 + n * 1e-6) for n in range(rng.randrange(1, 4))]
        blocks.setdefault(i // 4, []).append(tx(f"t{i}", ins, outs))
    want = sequential(blocks, ["a0", "a1"], 2, 25, 20_000_000, 2)
    found = T.trace(ledger(spark, tmp_path, blocks), seeds(spark, "a0", "a1"), 2, 25, 20_000_000, 0, 2)
    assert (rows(found.hops, "depth", "txid", "n", "address", "followed"), rows(found.service_stops, "depth", "txid", "outside")) == want


def test_trace_resumes_levels(spark, tmp_path, monkeypatch):
    chain, folder = ledger(spark, tmp_path, LINEAR), str(tmp_path / "levels")
    fresh = T.trace(chain, seeds(spark, "S"), max_depth=3, min_sats=100_000)
    T.trace(chain, seeds(spark, "S"), max_depth=2, min_sats=100_000, resume=folder)
    worked, level = [], T._level
    monkeypatch.setattr(T, "_level", lambda *a: worked.append(a[6]) or level(*a))
    again = T.trace(chain, seeds(spark, "S"), max_depth=3, min_sats=100_000, resume=folder)
    assert worked == [3] and again.levels == fresh.levels
    for name in ("hops", "links", "transactions", "activity", "coinjoin_stops"):
        assert sorted(map(str, getattr(again, name).collect())) == sorted(map(str, getattr(fresh, name).collect()))
    T.trace(chain, seeds(spark, "S", "U"), max_depth=1, min_sats=100_000, resume=folder)
    assert worked == [3, 1]


def test_components_of_any_size(spark):
    """Both ways of joining edges, on chains, stars, rings and loops."""
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 202), (202, 200), (300, 300), (301, 301), (301, 302), (None, 5)]
    edges += [(rng.randrange(400, 480), rng.randrange(400, 480)) for _ in range(60)]
    parent = {x: x for e in edges for x in e if None not in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    want = sorted((x, root(x)) for x in parent)
    table = spark.createDataFrame(edges, "src long, dst long")
    for few in (0, 1 << 17):
        assert sorted(map(tuple, connected_components(table, few=few).collect())) == want
        assert connected_components(table.limit(0), few=few).count() == 0
    named = spark.createDataFrame([("b", "a"), ("c", "b"), ("é", "z")], "src string, dst string")
    assert sorted(map(tuple, connected_components(named).collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("z", "z"), ("é", "z")]


def test_full_trace_agrees_with_a_sequential_model(spark):
    """The registered query, three levels with sweeps and a cap, against plain Python on the same ledger."""
    data = "/root/testdata/sf0.001"
    found = V.ledger(spark, data)
    tx = {r["txid"]: r for r in found.tx.collect()}
    blocks = {}
    mixes = {r["txid"] for r in L.coinjoin_flags(found).where("coinjoin").collect()}
    sides = {name: {} for name in ("vin", "vout")}
    for name, table, place in (("vin", found.tx_in, "in_index"), ("vout", found.tx_out, "n")):
        for r in table.collect():
            sides[name].setdefault(r["txid"], []).append((r[place], r["address"], r["sats"]))
    for txid, r in tx.items():
        blocks.setdefault(r["height"], []).append((r["tx_index"], txid))
    known = {r["address"] for r in V.seeds(spark, data).collect()}
    frontier, done, want = dict.fromkeys(known, 0), set(), []
    for depth in (1, 2, 3):
        following = {}
        for height in sorted(blocks):
            for _, txid in sorted(blocks[height]):
                senders = list(dict.fromkeys(a for _, a, _ in sorted(sides["vin"].get(txid, []))))
                spenders = [a for a in senders if a in frontier]
                if not spenders or txid in done or height < min(frontier[a] for a in spenders):
                    continue
                done.add(txid)
                outs = sorted(sides["vout"].get(txid, []))
                if txid in mixes or sum(a not in known for a in senders) >= catalog.SWEEP and len(outs) <= 2:
                    continue
                for n, address, sats in outs:
                    follow = sats >= 2000 and address not in known and len(known) < 400
                    if follow:
                        known.add(address)
                        following[address] = height
                    want.append((depth, txid, n, address, sats, follow))
        frontier = following
    got = catalog.QUERIES["full_trace"](spark, data).select("depth", "txid", "n", "address", "sats", "followed").collect()
    assert sorted(map(tuple, got)) == sorted(want)
