import hashlib
import http.server
import io
import json
import random
import threading
from pathlib import Path

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerflow.functions import crypto, reveal
from ledgerflow.functions import scripts as S
from ledgerflow.operators import exposure as X
from ledgerflow.operators import utxo as U
from ledgerflow.operators.ledger import Ledger, with_times
from ledgerflow.plans import cli, progress, render, reports
from ledgerflow.sources import node, rawblocks, sanctions, snapshot

GX = bytes.fromhex("79be667ef9dcbbac55a06295ce870b07029bfcdb2dce28d959f2815b16f81798")
KEY = crypto.lift_key(2, GX)
SHORT = b"\2" + GX
H = "ab" * 20

SCRIPTS = [
    (f"21{SHORT.hex()}ac", S.P2PK),
    (f"41{KEY.hex()}ac", S.P2PK),
    (f"5121{SHORT.hex()}21{SHORT.hex()}52ae", S.P2MS),
    (f"76a914{H}88ac", S.P2PKH),
    (f"A914{H.upper()}87", S.P2SH),
    (f"0014{H}", S.P2WPKH),
    ("0020" + "cd" * 32, S.P2WSH),
    ("5120" + "cd" * 32, S.P2TR),
    ("51024e73", S.ANCHOR),
    ("6a0401020304", S.NULLDATA),
    (f"5214{H}", S.WITNESS_UNKNOWN),
    ("5101ff", S.NONSTANDARD),
    ("", S.NONSTANDARD),
    ("ff00", S.NONSTANDARD),
    (f"5215{H}", S.NONSTANDARD),
]


def test_script_classes(spark):
    df = spark.createDataFrame([*SCRIPTS, (None, None)], "script string, want string")
    got = df.withColumn("got", S.script_type(F.col("script"))).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_keys_and_addresses():
    assert crypto.hash160(SHORT).hex() == "751e76e8199196d454941c45d1b3a323f1433bd6"
    assert crypto._ripemd160(b"abc") == hashlib.new("ripemd160", b"abc").digest()
    assert [h.hex() for h in reveal.of_key(KEY)] == ["91b24bf9f5288532960ac687abb035127b1d28a5", "751e76e8199196d454941c45d1b3a323f1433bd6", "bcfeb728b584253d5f3f70bcb780e9ef218a68f4"]
    assert crypto.address_script("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4").hex() == "0014751e76e8199196d454941c45d1b3a323f1433bd6"
    for bad in ("", "1", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5"):
        with pytest.raises(ValueError):
            crypto.address_script(bad)


@given(st.integers(0, 21 * 10**14))
def test_amounts_round_trip(n):
    assert snapshot.expand_amount(snapshot.pack_amount(n)) == n


@given(st.binary(max_size=80))
def test_pushes_never_fail(script):
    assert all(isinstance(x, bytes) for x in reveal.pushes(script))


def _coins():
    rng = random.Random(7)
    kinds = [lambda: b"\x76\xa9\x14" + rng.randbytes(20) + b"\x88\xac", lambda: b"\xa9\x14" + rng.randbytes(20) + b"\x87", lambda: b"\x21" + SHORT + b"\xac", lambda: b"\x41" + KEY + b"\xac", lambda: b"\0\x14" + rng.randbytes(20), lambda: b"\x6a" + rng.randbytes(9)]
    txids = [rng.randbytes(32) for _ in range(60)]
    pairs = sorted({(rng.choice(txids), rng.randrange(400)) for _ in range(300)})
    return [(t, v, rng.randrange(800_000), bool(rng.randrange(2)), rng.randrange(10**10), rng.choice(kinds)()) for t, v in pairs]


def test_snapshot_reader(spark, tmp_path):
    coins, path = _coins(), tmp_path / "utxo.dat"
    data = snapshot.write_snapshot(coins, base_hash="11" * 32)
    path.write_bytes(data)
    df = snapshot.read_snapshot(spark, str(path), 50)
    got = sorted((bytes.fromhex(r["txid"])[::-1], r["vout"], r["height"], r["coinbase"], r["sats"], bytes.fromhex(r["script"])) for r in df.collect())
    assert got == sorted(coins) and df.rdd.getNumPartitions() > 3
    assert snapshot.read_header(data) == snapshot.Header("main", "11" * 32, len(coins))
    digest = hashlib.sha256()
    for t, v, h, c, s, script in sorted(coins):
        digest.update(t + v.to_bytes(4, "little") + (2 * h + c).to_bytes(4, "little") + s.to_bytes(8, "little") + bytes((len(script),)) + script)
    assert snapshot.hash_of(str(path)) == snapshot.set_hash(io.BytesIO(data)) == hashlib.sha256(digest.digest()).digest()[::-1].hex()
    for broken in (b"x" + data, data[:5] + b"\3\0" + data[7:], data[:-3], data + b"\0"):
        with pytest.raises(snapshot.SnapshotError):
            snapshot.index(io.BytesIO(broken))


def test_snapshot_index_is_kept(tmp_path, monkeypatch):
    path = tmp_path / "utxo.dat"
    path.write_bytes(snapshot.write_snapshot(_coins()))
    monkeypatch.setattr(snapshot, "WINDOW", 7)  # a window much smaller than the file
    made = snapshot.stretches(str(path), 40)
    assert made[0][0] == snapshot.HEADER and made[-1][1] == path.stat().st_size and sum(n for _, _, n in made) == len(_coins())
    monkeypatch.setattr(snapshot, "index", None)  # not called again
    assert snapshot.stretches(str(path), 40) == made
    monkeypatch.undo()
    path.write_bytes(snapshot.write_snapshot(_coins()[:20]))
    assert sum(n for _, _, n in snapshot.stretches(str(path), 40)) == 20


def _block(inputs):
    def one(sig, witness, marked):
        raw = b"\2\0\0\0" + (b"\0\1" if marked else b"") + b"\1" + b"\7" * 36 + snapshot.compact(len(sig)) + sig + b"\xff" * 4 + b"\1" + b"\0" * 8 + b"\0"
        if marked:
            raw += snapshot.compact(len(witness)) + b"".join(snapshot.compact(len(w)) + w for w in witness)
        return raw + b"\0" * 4

    return b"\0" * 80 + snapshot.compact(len(inputs) + 1) + one(b"\1\1", [], False) + b"".join(one(s, w, bool(w)) for s, w in inputs)


def test_reveals_and_scan(spark):
    signature = b"\x30\x44" + b"\1" * 69
    redeem = b"\x51\x21" + SHORT + b"\x51\xae"
    inputs = [(bytes((71,)) + signature + b"\x21" + SHORT, []), (b"", [signature, KEY]), (b"\0" + bytes((len(redeem),)) + redeem, []), (b"", [b"", redeem]), (b"", [b"\1" * 64]), (b"\1\1" * 0 + bytes((71,)) + signature, [])]
    counts = [len(reveal.of_input(s, w)) for s, w in inputs]
    assert counts == [2, 3, 3, 3, 0, 0]
    raw = _block(inputs)
    blocks = spark.createDataFrame([(5, bytearray(raw)), (1005, bytearray(_block([])))], "height int, raw binary")
    targets = spark.createDataFrame([(bytearray(crypto.hash160(SHORT)),), (bytearray(b"\0" * 20),)], "key_hash binary")
    assert [bytes(r[0]) for r in rawblocks.reveal_scan(blocks, targets).collect()] == [crypto.hash160(SHORT)]
    metrics = {r["start"]: (r["blocks"], r["inputs"], r["reveals"]) for r in rawblocks.range_metrics(blocks).collect()}
    assert metrics == {0: (1, 6, 11), 1000: (1, 0, 0)}
    with pytest.raises(ValueError):
        list(rawblocks.block_inputs(raw + b"\0"))


FORMS = [
    ("key", bytes((71,)) + b"\x30\x44" + b"\1" * 69 + b"\x21" + SHORT, [], 2),
    ("witness key", b"", [b"\x30\x44" + b"\1" * 69, KEY], 3),
    ("taproot key", b"", [b"\1" * 64], 0),
    ("taproot key", b"", [b"\1" * 65, b"\x50annex"], 0),
    ("taproot script", b"", [b"\1", b"\x51", b"\xc0" + b"\2" * 64], 0),
    ("witness script", b"", [b"\1", b"\x51", b"\xc0" + b"\2" * 63], 1),
    ("witness script", b"\x22" + b"\0" * 34, [b"\x51"], 2),
    ("signature", bytes((71,)) + b"\x30\x44" + b"\1" * 69, [], 0),
    ("signature", b"", [], 0),
    ("script", b"\x01\x51", [], 1),
]


@pytest.mark.parametrize("name, script_sig, witness, hashes", FORMS)
def test_forms_of_spends(name, script_sig, witness, hashes):
    spend = reveal.Spend(script_sig, tuple(witness))
    assert reveal.form_of(spend).name == name and len(reveal.of_input(script_sig, witness)) == hashes


def test_scan_resumes_and_guards(spark, tmp_path):
    key = bytes((71,)) + b"\x30\x44" + b"\1" * 69 + b"\x21" + SHORT
    stored = spark.createDataFrame([(h, bytearray(_block([(key, [])] if h % 4 == 0 else []))) for h in range(25)], "height int, raw binary")
    targets = spark.createDataFrame([(bytearray(crypto.hash160(SHORT)),)], "key_hash binary")
    asked = []

    def blocks_of(heights, fail=False):
        asked.append((heights.start, heights.stop))
        if fail:
            raise RuntimeError("cut off")
        return stored.where(F.col("height").between(heights.start, heights.stop - 1))

    path, told = str(tmp_path / "scan"), []
    with pytest.raises(RuntimeError):
        rawblocks.scan_chain(spark, lambda h: blocks_of(h, h.start >= 10), 19, targets, path, "aa", 5, 2)
    assert asked == [(0, 10), (10, 20)]
    found, sums = rawblocks.scan_chain(spark, blocks_of, 19, targets, path, "aa", 5, 2, told=lambda a, b: told.append((a, b)))
    assert asked == [(0, 10), (10, 20), (10, 20)] and told == [(2, 4), (4, 4)]
    assert [bytes(r[0]) for r in found.collect()] == [crypto.hash160(SHORT)] and (sums["blocks"], sums["inputs"], sums["reveals"]) == (20, 5, 10)
    _, more = rawblocks.scan_chain(spark, blocks_of, 22, targets, path, "aa", 5, 2)
    _, most = rawblocks.scan_chain(spark, blocks_of, 24, targets, path, "aa", 5, 2)
    assert (more["blocks"], most["blocks"], most["inputs"]) == (23, 25, 7) and asked[3:] == [(20, 23), (20, 25)]
    with pytest.raises(ValueError, match="different snapshot"):
        rawblocks.scan_chain(spark, blocks_of, 24, targets, path, "bb", 5, 2)


def test_utxo_report(spark):
    rows = [(0, True, 50 * 10**8, f"21{SHORT.hex()}ac"), (10, False, 7, f"76a914{H}88ac"), (299_000, False, 5, "5120" + "cd" * 32), (300_000, False, 3, "6a00")]
    coins = U.classified(spark.createDataFrame(rows, "height int, coinbase boolean, sats long, script string"))
    marked = U.with_revealed(coins, spark.createDataFrame([(bytearray(bytes.fromhex(H)),)], "key_hash binary"))
    snap = {"network": "main", "base_hash": "00", "base_height": 300_000, "date": None, "coins": 4}
    checks = snapshot.checks(snapshot.Header("main", "00", 4), 4, "aa", {"txoutset_hash": "ab", "base_hash": "00", "coins_written": 4})
    assert (checks["hash_matches"], checks["base_hash_matches"]) == (False, True)
    bare = reports.utxo_report(marked, snap, checks)
    assert reports.validate(bare) == [] and bare["totals"]["revealed_btc"] is None
    reuse = {"start_height": 0, "end_height": 1, "blocks": 1, "inputs": 1, "targets": 1, "revealed": 1}
    full = reports.utxo_report(marked, snap, checks, reuse=reuse, dates={0: "2009-01-03"})
    assert reports.validate(full) == []
    assert full["totals"]["dormant_btc"] == 50.00000007 and full["totals"]["exposed_btc"] == 50.00000012 and full["totals"]["coinbase_p2pk_coins"] == 1
    assert "2009" in render.utxo_page(full)


def test_exposure(spark):
    scripts = {"TAP": "5120" + "cd" * 32, "OLD": f"0014{H}", "NEW": "76a914" + "01" * 20 + "88ac", "NIL": "0014" + "02" * 20}
    asked = spark.createDataFrame(list(scripts.items()), "address string, script string")
    utxo = spark.createDataFrame([(2, 359000000, scripts["OLD"]), (9, 0, scripts["OLD"]), (5, 150000000, scripts["TAP"]), (4, 250000000, scripts["NEW"]), (1, 0, scripts["NIL"])], "height int, sats long, script string")
    spends = [("t9", 9, 0, 777600, "OLD"), ("t5", 5, 1, 432000, "OLD"), ("t5b", 5, 2, 432000, "OLD"), ("t1", 1, 0, 86400, "NIL")]
    tx = spark.createDataFrame([(a, b, c, d) for a, b, c, d, _ in spends], "txid string, height int, tx_index int, time long")
    tx_in = spark.createDataFrame([(x[0], x[4]) for x in spends], "txid string, address string")
    info = spark.createDataFrame([("OLD", "100", "E"), ("NEW", None, None)], "address string, sdn_ref string, sdn_name string")
    rows = X.exposure(asked, utxo, Ledger(tx, tx_in, tx_in), info)
    got = {r["address"]: (r["status"], r["first_txid"], r["utxos"]) for r in rows.collect()}
    assert got == {"TAP": (X.VISIBLE, None, 1), "OLD": (X.SPENT_BEFORE, "t5", 2), "NEW": (X.HIDDEN, None, 1), "NIL": (X.NO_BALANCE, None, 1)}
    report = reports.exposure_report(rows, {"height": 9, "bestblock": "b", "date": None, "utxos_scanned": 5})
    assert reports.validate(report) == [] and report["totals"]["exposed_btc"] == 5.09 and report["by_entry"][0]["balance_btc"] == 3.59
    report["addresses"][0]["exposed"] = not report["addresses"][0]["exposed"]
    assert "disagree" in reports.validate(report)[0]


XML = """<L xmlns="urn:x"><ReferenceValueSets><FeatureTypeValues><FeatureType ID="1">Digital Currency Address - XBT</FeatureType>
<FeatureType ID="2">Website</FeatureType></FeatureTypeValues></ReferenceValueSets><DistinctParties><DistinctParty FixedRef="007"><Profile><Identity>
<Alias Primary="false"><DocumentedName><DocumentedNamePart><NamePartValue>OTHER</NamePartValue></DocumentedNamePart></DocumentedName></Alias>
<Alias Primary="true"><DocumentedName><DocumentedNamePart><NamePartValue>FIRST</NamePartValue></DocumentedNamePart><DocumentedNamePart><NamePartValue>LAST</NamePartValue></DocumentedNamePart></DocumentedName></Alias>
</Identity><Feature FeatureTypeID="1"><FeatureVersion><VersionDetail DetailTypeID="9">1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa</VersionDetail></FeatureVersion></Feature>
<Feature FeatureTypeID="1"><FeatureVersion><VersionDetail DetailTypeID="9">nonsense</VersionDetail></FeatureVersion></Feature>
<Feature FeatureTypeID="2"><FeatureVersion><VersionDetail DetailTypeID="9">example.invalid</VersionDetail></FeatureVersion></Feature></Profile></DistinctParty></DistinctParties></L>"""


def test_sanctions_and_seeds(spark, tmp_path):
    path = tmp_path / "list.xml"
    path.write_text(XML)
    found, rejected = sanctions.listed_addresses(spark, str(path))
    assert [tuple(r) for r in found.collect()] == [("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "007", "FIRST LAST")] and [r[0] for r in rejected.collect()] == ["nonsense"]
    with pytest.raises(ValueError):
        sanctions.listed_addresses(spark, str(path), "ZZZ")
    text = tmp_path / "seeds.txt"
    text.write_text("# list\nA # one\n\nB\n")
    assert sorted(r["address"] for r in sanctions.read_seeds(spark, str(text)).collect()) == ["A", "B"]
    with pytest.raises(ValueError):
        sanctions.of_entry(sanctions.read_seeds(spark, str(text)), "7")
    listed = tmp_path / "seeds.json"
    entries = [("A", "9", "NINE"), ("B", "", "none"), ("A", "1", "ONE"), ("A", "1", ""), ("B", "2", "TWO")]
    listed.write_text(json.dumps({"addresses": [dict(zip(("address", "sdn_ref", "sdn_name"), e, strict=True)) for e in entries]}))
    found = sanctions.select_seeds(sanctions.read_seeds(spark, str(listed))).collect()
    assert sorted(map(tuple, found)) == [("A", "9", "ONE"), ("B", "2", "TWO")]


def test_node_replays_and_retries(tmp_path):
    class Fixed:
        def call(self, method, params):
            return {"blocks": 3} if method == "getblockchaininfo" else 3

    recorded = node.Node(node.Record(Fixed(), tmp_path))
    assert recorded.tip() == 3 and node.Node(node.Replay(tmp_path)).tip() == 3
    assert node.Node.from_env({"LEDGERFLOW_REPLAY": str(tmp_path)}).tip() == 3
    assert len(node.reply_name("m", ["x" * 500])) < 160
    with pytest.raises(node.NodeError):
        node.Replay(tmp_path).call("absent", [])

    assert node.reply_name("getblock", ["ab", 3]) == "getblock__ab_3.json" and node.reply_name("getblockcount", []) == "getblockcount.json"
    assert node.reply_name("scanblocks", ["start", ["addr(A)"], 0]) == "scanblocks__start_--addr-A---_0.json"


class Script(http.server.BaseHTTPRequestHandler):
    """Answers by a plan: drop, slow, refuse, error, or the numbers asked for."""

    plan: list = []
    seen: list = []
    protocol_version = "HTTP/1.1"

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        type(self).seen.append((self.client_address[1], body))
        what = type(self).plan.pop(0) if type(self).plan else "answer"
        if what == "drop":
            self.connection.close()
            self.close_connection = True
            return
        answer = lambda c: {"id": c["id"], "result": c["params"], "error": None}
        reply = list(reversed([answer(c) for c in body])) if isinstance(body, list) else answer(body) if what == "answer" else {"id": 0, "result": None, "error": {"code": -1, "message": "no such thing"}}
        text = json.dumps(reply).encode() if what != "login" else b""
        self.send_response(401 if what == "login" else 500 if what == "error" else 200)
        self.send_header("Content-Length", str(len(text)))
        self.end_headers()
        self.wfile.write(text)

    def log_message(self, *_):
        pass


def test_node_over_a_kept_connection():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Script)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    waits = []
    link = node.Http(f"http://127.0.0.1:{server.server_port}/", "u", "p", patience=node.Patience(wait=waits.append))
    try:
        assert link.call("getblock", ["a", 3]) == ["a", 3] and link.call("getblock", ["b", 3]) == ["b", 3]
        assert link.batch("getblockhash", [[n] for n in range(5)]) == [[n] for n in range(5)] and link.batch("x", []) == []
        assert len({port for port, _ in Script.seen}) == 1 and len(Script.seen) == 3
        Script.plan[:] = ["drop", "drop", "answer"]
        assert link.call("getblockcount", []) == [] and waits == [2.0, 4.0]
        Script.plan[:] = ["drop"]
        with pytest.raises(node.Dropped):
            link.call("dumptxoutset", ["a"])
        Script.plan[:] = ["drop"] * 4
        with pytest.raises(node.Dropped):
            link.call("getblockcount", [])
        assert waits == [2.0, 4.0, 2.0, 4.0, 8.0]
        Script.plan[:] = ["error"]
        with pytest.raises(node.NodeError, match="no such thing"):
            link.call("getblock", ["c"])
        Script.plan[:] = ["login"]
        with pytest.raises(node.NodeError, match="user or password"):
            link.call("getblock", ["c"])
    finally:
        server.shutdown()
    with pytest.raises(node.NodeError, match="can't be reached"):
        node.Http("http://127.0.0.1:1/", patience=node.Patience(wait=waits.append)).call("getblockcount", [])


def test_scans_are_stopped_and_explained():
    calls = []

    class Busy:
        def __init__(self, reply):
            self.reply = reply

        def call(self, method, params):
            calls.append((method, params[0]))
            if params[0] == "abort":
                return True
            if isinstance(self.reply, Exception):
                raise self.reply
            return self.reply

    with pytest.raises(node.TooSlow):
        node.Node(Busy(node.TooSlow("late"))).scan_blocks(["A"], 0, 9)
    assert calls == [("scanblocks", "start"), ("scanblocks", "abort")]
    with pytest.raises(node.NodeError, match="another scan"):
        node.Node(Busy(node.NodeError("Scan already in progress"))).scan_utxos(["A"])
    with pytest.raises(node.NodeError, match="was stopped"):
        node.Node(Busy({"completed": False, "relevant_blocks": []})).scan_blocks(["A"], 0, 9)
    heights = []
    assert node.Node(Busy({"completed": True, "relevant_blocks": ["x"]}), 4).scan_blocks(["A"], 0, 9, told=lambda a, b: heights.append((a, b))) == ["x"]
    assert heights == [(0, 3), (4, 7), (8, 9)]


def test_blocks_from_a_node(spark, tmp_path):
    """Executors fetch what was saved: decoded, raw, and block times."""
    raw = _block([])
    save = lambda method, params, value: (tmp_path / node.reply_name(method, params)).write_text(json.dumps(value))
    for h in range(5):
        save("getblockhash", [h], f"h{h}")
        save("getblock", [f"h{h}", 0], raw.hex())
        save("getblock", [f"h{h}", 3], {"hash": f"h{h}", "height": h, "time": 7 * h, "tx": [{"txid": f"t{h}", "vin": [{"coinbase": "00"}], "vout": []}]})
        save("getblockheader", [f"h{h}"], {"time": 7 * h})
    live = node.Node(node.Replay(tmp_path))
    got = node.fetch_raw_blocks(spark, live, range(1, 5), 2).orderBy("height").collect()
    assert [(r["height"], bytes(r["raw"])) for r in got] == [(h, raw) for h in range(1, 5)]
    assert sorted(r["tx"][0]["txid"] for r in node.fetch_blocks(spark, live, range(0, 3)).collect()) == ["t0", "t1", "t2"]
    times = node.block_times(spark, live, range(0, 5))
    tx = spark.createDataFrame([("a", 2, None), ("b", 3, 1), ("c", 9, None)], "txid string, height int, time long")
    filled = with_times(Ledger(tx, tx, tx), times).tx
    assert sorted(map(tuple, filled.collect())) == [("a", 2, 14), ("b", 3, 1), ("c", 9, None)]


def test_pages_and_commands(tmp_path, capsys):
    assert "<script" not in render.markdown("# a <script>\n- x\n- [y](javascript:z) **b**\n\ntext `c`") and "<li>" in render.markdown("- x")
    assert render.markdown("1. a\n   b\n2. *c*\n- d") == "<ol><li>a b</li><li><i>c</i></li></ol>\n<ul><li>d</li></ul>"
    assert render.markdown("## T\none\n two [l](/x?a&b)") == '<h3>T</h3>\n<p>one two <a href="/x?a&amp;b" rel="noopener noreferrer">l</a></p>'
    assert render.axis(7)[-1] >= 7 and render.axis(0.3) == [0.0, 0.1, 0.2, 0.3] and render.months("2020-11", "2021-02") == ["2020-11", "2020-12", "2021-01", "2021-02"]
    assert "<svg" in render.columns(["a"], {"x": [1.0]}) and render.spans([("x", "2020-01-01", "2020-03-01")], [("2020-02-01", "<m>")]).startswith("<svg")
    assert [render.btc(1234.5), render.btc(2), render.compact(12_345), render.short("abcdefghijklmnopqrstuvwxyz", 3)] == ["1,234.5 BTC", "2 BTC", "12.3k", "abc…xyz"]
    assert render.el("p", "<&>", x='"') == '<p x="&quot;">&lt;&amp;&gt;</p>' and not render.allowed("javascript:x") and render.allowed("a/b")
    path = Path(tmp_path, "bad.json")
    path.write_text(json.dumps({"report_version": "0.1"}))
    assert cli.main(["validate", str(path)]) == 1 and "not supported" in capsys.readouterr().out
    assert cli.main(["show", str(tmp_path / "absent.json")]) == 1


def test_revealed_set_of_another_snapshot_is_refused(tmp_path, capsys):
    path = tmp_path / "utxo.dat"
    path.write_bytes(snapshot.write_snapshot(_coins(), base_hash="11" * 32))
    (tmp_path / "revealed.json").write_text(json.dumps({"base_hash": "22" * 32}))
    assert cli.main(["utxo-stats", str(path), "--revealed", str(tmp_path / "revealed")]) == 1
    assert "different snapshot" in capsys.readouterr().err
    (tmp_path / "revealed.json").unlink()
    assert cli.main(["utxo-stats", str(path), "--revealed", str(tmp_path / "revealed")]) == 1 and "is missing" in capsys.readouterr().err


def test_progress_writes_tenths_to_a_log():
    out = io.StringIO()
    told = progress.Progress("reading", "coins", out)
    for n in range(0, 101):
        told(n, 100)
    assert len(out.getvalue().splitlines()) == 11 and out.getvalue().splitlines()[-1] == "reading: 100%, 100 of 100 coins"
