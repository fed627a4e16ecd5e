"""Commands. 0: done; 1: an error, or a check that failed; 130: interrupted."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import functions as F

from ledgerflow.plans import render, reports


def _spark():
    from ledgerflow.session import local_session

    return local_session()


def _node():
    from ledgerflow.sources.node import Node

    return Node.from_env()


def _emit(report: dict, out: str | None) -> None:
    text = json.dumps(report, indent=1, ensure_ascii=False)
    Path(out).write_text(text) if out else print(text)


def _load(path: str) -> dict:
    report = json.loads(Path(path).read_text())
    if found := reports.validate(report):
        raise ValueError("\n".join(found))
    return report


def _seeds(spark, args):
    """Addresses of the command line, then those of the seed file, of one entry if asked for."""
    from ledgerflow.sources import sanctions

    given = spark.createDataFrame([(-1, a, None, None) for a in args.address or ()], sanctions.SEEDS)
    if not args.seeds:
        if args.sdn:
            raise ValueError("--sdn needs --seeds")
        return sanctions.select_seeds(given)
    listed = sanctions.of_entry(sanctions.read_seeds(spark, args.seeds), args.sdn)
    return sanctions.select_seeds(given.unionByName(listed))


def node(args) -> int:
    print(json.dumps(_node().summary(), indent=1))
    return 0


def sanctions(args) -> int:
    from ledgerflow.sources.sanctions import listed_addresses

    found, rejected = listed_addresses(_spark(), args.xml, args.ticker)
    _emit({"ticker": args.ticker, "addresses": [r.asDict() for r in found.collect()], "rejected": [r["value"] for r in rejected.collect()]}, args.out)
    return 0


def tx(args) -> int:
    from ledgerflow.operators import ledger as L
    from ledgerflow.sources.decoded import BLOCK, ledger_of

    spark = _spark()
    block = {"hash": "", "height": 0, "time": 0, "tx": [_node().transaction(args.txid)]}
    found = ledger_of(spark.read.schema(BLOCK).json(spark.sparkContext.parallelize([json.dumps(block)])))
    inputs = {r["address"]: r["inputs"] for r in L.input_counts(found).orderBy("first_index").collect()}
    labels = [r.asDict() for r in L.output_labels(found).orderBy("n").collect()]
    _emit({"txid": args.txid, "input_addresses": inputs, "coinjoin": bool(L.coinjoin_flags(found).first()["coinjoin"]), "outputs": labels}, args.out)
    return 0


def trace(args) -> int:
    from ledgerflow.operators.trace import trace as run
    from ledgerflow.sources.decoded import read_ledger

    spark = _spark()
    seeds = _seeds(spark, args)
    found = run(read_ledger(spark, args.ledger), seeds, args.depth, args.max_addresses, round(args.min_value * 1e8), args.start_height, args.service_min_inputs, resume=args.resume)
    if args.tables:
        reports.write_tables(found, args.tables, seeds)
        return 0
    report = reports.trace_report(found, seeds)
    _emit(report, args.out)
    if args.html:
        Path(args.html).write_text(render.trace_page(report))
    return 0


def exposure(args) -> int:
    from ledgerflow.functions.crypto import address_script
    from ledgerflow.operators import exposure as X
    from ledgerflow.sources.decoded import read_ledger

    spark = _spark()
    seeds = _seeds(spark, args)
    scripts = spark.createDataFrame([(r["address"], address_script(r["address"]).hex()) for r in seeds.collect()], "address string, script string")
    utxo, ledger = spark.read.parquet(args.utxo), read_ledger(spark, args.ledger)
    rows = X.exposure(scripts, utxo, ledger, seeds)
    tip = utxo.agg(F.max("height"), F.count("*")).first()
    _emit(reports.exposure_report(rows, {"height": tip[0] or 0, "bestblock": "", "date": None, "utxos_scanned": tip[1]}), args.out)
    return 0


def dump_utxos(args) -> int:
    _emit(_node().dump_utxos(args.name), args.out)
    return 0


def _beside(path: str, suffix: str) -> str:
    return str(Path(path).with_suffix(suffix))


def _revealed(spark, path: str, summary: str, base_hash: str):
    """Matches of a reveal scan and its summary, if it was made for this snapshot."""
    if not Path(summary).exists():
        raise ValueError(f"{summary} is missing; reveal-scan writes it beside its matches")
    said = json.loads(Path(summary).read_text())
    if said.get("base_hash") != base_hash:
        raise ValueError(f"{path} was made for a different snapshot")
    return spark.read.parquet(path), {k: v for k, v in said.items() if k != "base_hash"}


def utxo_stats(args) -> int:
    from ledgerflow.operators import utxo as U
    from ledgerflow.sources import snapshot as S

    spark = _spark()
    header = S.header_of(args.snapshot)
    coins = U.classified(S.read_snapshot(spark, args.snapshot), args.bin_size)
    found, reuse = spark.createDataFrame([], "key_hash binary"), None
    if args.revealed:
        found, reuse = _revealed(spark, args.revealed, args.reuse or args.revealed.rstrip("/") + ".json", header.base_hash)
    marked = U.with_revealed(coins, found)
    info = args.info or _beside(args.snapshot, ".json")
    said = json.loads(Path(info).read_text()) if Path(info).exists() else None
    top = marked.agg(F.max("height"), F.count("*")).first()
    checks = S.checks(header, top[1], S.hash_of(args.snapshot) if args.verify else None, said)
    snapshot = {"network": header.network, "base_hash": header.base_hash, "base_height": (said or {}).get("base_height", top[0] or 0), "date": None, "coins": header.coins}
    report = reports.utxo_report(marked, snapshot, checks, args.bin_size, reuse=reuse)
    _emit(report, args.out)
    return int(any(v is False for v in checks.values()))


def reveal_scan(args) -> int:
    """Scan the blocks of a folder, or of the node, for what they reveal of a snapshot's coins; an interrupted scan goes on."""
    from ledgerflow.operators import utxo as U
    from ledgerflow.plans.progress import Progress
    from ledgerflow.session import materialize
    from ledgerflow.sources import node as N
    from ledgerflow.sources import rawblocks as B
    from ledgerflow.sources import snapshot as S

    spark = _spark()
    header = S.header_of(args.snapshot)
    targets = materialize(U.hash_targets(U.classified(S.read_snapshot(spark, args.snapshot))), "targets")
    if args.blocks:
        stored = B.read_blocks(spark, args.blocks)
        stop = args.stop if args.stop is not None else stored.agg(F.max("height")).first()[0]
        blocks_of = lambda heights: stored.where(F.col("height").between(heights.start, heights.stop - 1))
    else:
        live = _node()
        stop = args.stop if args.stop is not None else live.tip()
        blocks_of = lambda heights: N.fetch_raw_blocks(spark, live, heights)
    work = args.work or args.out.rstrip("/") + ".work"
    matched, sums = B.scan_chain(spark, blocks_of, stop, targets, work, header.base_hash, told=Progress("scanning", "ranges"))
    matched.write.mode("overwrite").parquet(args.out)
    reuse = {"start_height": 0, "end_height": stop, "blocks": sums["blocks"], "inputs": sums["inputs"], "targets": targets.count(), "revealed": spark.read.parquet(args.out).count()}
    Path(args.summary or args.out.rstrip("/") + ".json").write_text(json.dumps(reuse | {"base_hash": header.base_hash}))
    print(json.dumps(reuse))
    return 0


def show(args) -> int:
    report = _load(args.report)
    kind = reports.kind_of(report)
    if kind == "trace":
        print(f"{len(report['seeds'])} seeds, {len(report['hops'])} hops, {len(report['clusters'])} clusters to height {report['scanned_to_height']}")
        for h in report["hops"][: args.rows]:
            print(f"  {h['depth']} {h['date'] or '-'} {render.short(h['txid'])} -> {render.short(h['to_address'])} {render.btc(h['value_btc'])} {h['label']}{' *' if h['followed'] else ''}")
        for s in report["seed_summaries"][: args.rows]:
            print(f"  {render.short(s['address'])}: {s['spending_txs']} transactions, net {render.btc(s['net_out_btc'])}")
    elif kind == "exposure":
        t = report["totals"]
        print(f"{t['addresses']} addresses, {t['funded_addresses']} funded: {render.btc(t['balance_btc'])}, exposed {render.btc(t['exposed_btc'])}")
        for a in report["addresses"][: args.rows]:
            print(f"  {render.short(a['address'])} {render.btc(a['balance_btc'])} {a['status']}")
    else:
        print(f"{report['totals']['coins']:,} coins, {render.btc(report['totals']['btc'])}")
        for name, k in report["by_type"].items():
            print(f"  {name}: {k['coins']:,} coins, {render.btc(k['btc'])}")
    return 0


def validate(args) -> int:
    found = reports.validate(json.loads(Path(args.report).read_text()))
    print("\n".join(found) or "valid")
    return int(bool(found))


def report(args) -> int:
    found = _load(args.report)
    notes = Path(args.notes).read_text() if args.notes else ""
    if reports.kind_of(found) == "utxo-set":
        text = render.utxo_page(found, _load(args.exposure) if args.exposure else None, args.title or "Visible keys", notes)
    else:
        text = render.trace_page(found, args.title, notes)
    Path(args.out).write_text(text)
    return 0


def scan_status(args) -> int:
    print(json.dumps(_node().scan_status()))
    return 0


def scan_abort(args) -> int:
    print("stopped" if _node().abort_scan() else "no scan was running")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ledgerflow", description=__doc__)
    commands = top.add_subparsers(required=True, metavar="COMMAND")

    def command(name: str, run, *options: tuple) -> None:
        sub = commands.add_parser(name)
        sub.set_defaults(run=run)
        for flag, more in options:
            sub.add_argument(flag, **more)

    out, seeds = ("--out", {}), (("address", {"nargs": "*"}), ("--seeds", {}), ("--sdn", {}))
    command("node", node)
    command("sanctions", sanctions, ("xml", {}), ("--ticker", {"default": "XBT"}), out)
    command("tx", tx, ("txid", {}), out)
    limits = (("--depth", {"type": int, "default": 2}), ("--max-addresses", {"type": int, "default": 100}), ("--min-value", {"type": float, "default": 0.0}), ("--start-height", {"type": int, "default": 0}), ("--service-min-inputs", {"type": int, "default": 20}))
    command("trace", trace, *seeds, ("--ledger", {"required": True}), *limits, ("--resume", {}), ("--tables", {}), ("--html", {}), out)
    command("exposure", exposure, *seeds, ("--ledger", {"required": True}), ("--utxo", {"required": True}), out)
    command("show", show, ("report", {}), ("--rows", {"type": int, "default": 20}))
    command("validate", validate, ("report", {}))
    command("report", report, ("report", {}), ("--exposure", {}), ("--notes", {}), ("--title", {}), ("--out", {"required": True}))
    command("dump-utxos", dump_utxos, ("name", {}), out)
    command("utxo-stats", utxo_stats, ("snapshot", {}), ("--verify", {"action": "store_true"}), ("--revealed", {}), ("--reuse", {}), ("--info", {}), ("--bin-size", {"type": int, "default": 1000}), out)
    command("reveal-scan", reveal_scan, ("snapshot", {}), ("--blocks", {}), ("--stop", {"type": int}), ("--work", {}), ("--out", {"required": True}), ("--summary", {}))
    command("scan-status", scan_status)
    command("scan-abort", scan_abort)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except KeyboardInterrupt:
        return 130
    except (ValueError, OSError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
