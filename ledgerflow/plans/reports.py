"""The three JSON reports: built from result tables, and checked field by field."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions import scripts as S
from ledgerflow.operators import clusters as C
from ledgerflow.operators import exposure as X
from ledgerflow.operators import ledger as L
from ledgerflow.operators import outflow as O
from ledgerflow.operators import trace as T
from ledgerflow.operators import utxo as U
from ledgerflow.session import materialize

VERSIONS = {"trace": "1.0", "exposure": "1.0", "utxo-set": "1.1"}
INTERNAL, SERVICE = "internal consolidation (heuristic)", "service consolidation (heuristic)"
NOTE = "All labels, clusters and flows are heuristic estimates. They are leads, never proof of ownership or identity."
FLOW = {
    "to_outside_addresses": "btc",
    "to_outside_addresses_core": "btc",
    "into_service_sweeps": "btc",
    "into_service_sweeps_core": "btc",
    "into_coinjoins": "btc",
    "to_other_seed_clusters": "btc",
    "spending_txs": "count",
    "total": "btc",
    "total_core": "btc",
}
_STOP = {"depth": "positive", "height": "count", "date": "day?", "txid": "text", "from_addresses": ["text"], "traced_value_btc": "btc"}
_SUMS = {"addresses": "count", "funded_addresses": "count", "exposed_addresses": "count", "balance_btc": "btc", "exposed_btc": "btc", "hash_only_btc": "btc"}
STATUSES = (X.VISIBLE, X.SPENT_BEFORE, X.HIDDEN, X.NO_BALANCE, X.NOT_APPLICABLE)

#: Shapes: a dict has exactly these fields; ("map", shape) any keys; [shape] a list; (a, b) one of two; a set of choices;
#: a word names a scalar, with ? where null is allowed.
SHAPES: dict[str, Any] = {
    "trace": {
        "report_version": {"1.0"},
        "seeds": ["text"],
        "parameters": {"max_depth": "positive", "max_addresses": "positive?", "min_value_btc": "btc", "start_height": "count", "service_min_inputs": "count"},
        "scanned_to_height": "count",
        "seed_info": ("map", {"sdn_ref": "text", "sdn_name": "string"}),
        "seed_summaries": [
            {
                "address": "text",
                "sdn_ref": "string?",
                "sdn_name": "string?",
                "cluster": "positive?",
                "cluster_size": "positive",
                "spending_txs": "count",
                "spent_btc": "btc",
                "returned_btc": "btc",
                "net_out_btc": "number",
                "first_spend": "day?",
                "last_spend": "day?",
                "first_spend_height": "count?",
                "last_spend_height": "count?",
            }
        ],
        "outflow_total": (FLOW, {}),
        "entities": [{"sdn_ref": "string?", "sdn_name": "string?", "seeds": "positive", "clusters": "count", "cluster_addresses": "count", "outflow": FLOW, "outflow_by_month": ("map", ["btc"])}],
        "levels": [{"depth": "positive", "addresses": "count", "scanned_from_height": "count", "candidate_blocks": "count", "blocks_touching": "count", "spending_txs": "count"}],
        "transactions": ("map", {"height": "count", "date": "day?", "input_addresses": "count", "outside_inputs": "count", "outside_inputs_sample": ["text"], "outputs": "count", "batch_sweep": "bool"}),
        "hops": [
            {
                "depth": "positive",
                "height": "count",
                "date": "day?",
                "txid": "text",
                "from_addresses": ["text"],
                "vout": "count",
                "to_address": "text",
                "value_btc": "btc",
                "label": {L.CHANGE, L.PAYMENT, L.UNDETERMINED},
                "reasons": ["text"],
                "followed": "bool",
            }
        ],
        "coinjoin_stops": [_STOP],
        "service_stops": [_STOP | {"input_addresses": "count", "outside_inputs": "count", "outputs": [{"address": "string?", "value_btc": "btc"}], "classification": {INTERNAL, SERVICE}}],
        "clusters": [
            {
                "addresses": ["text"],
                "seeds": ["text"],
                "evidence": [{"kind": {"common input", "change"}, "txid": "text", "height": "count", "batch_sweep": "bool"}],
                "batch_links": "count",
                "size_without_batch_sweeps": "positive",
                "outflow": (FLOW, None),
            }
        ],
        "unexplored": ["text"],
        "truncated": "bool",
        "note": "string",
    },
    "exposure": {
        "report_kind": {"exposure"},
        "report_version": {"1.0"},
        "snapshot": {"height": "count", "bestblock": "string", "date": "day?", "utxos_scanned": "count"},
        "totals": _SUMS,
        "by_type": ("map", _SUMS),
        "by_entry": [{"sdn_ref": "text", "sdn_name": "string?"} | _SUMS],
        "addresses": [
            {
                "address": "text",
                "script_type": set(S.LABELS),
                "sdn_ref": "string?",
                "sdn_name": "string?",
                "balance_btc": "btc",
                "utxos": "count",
                "oldest_utxo_height": "count?",
                "status": set(STATUSES),
                "exposed": "bool",
                "first_spend": ({"height": "count", "date": "day?", "txid": "text"}, None),
            }
        ],
        "candidate_blocks": "count",
        "blocks_checked": "count",
        "note": "string",
    },
    "utxo-set": {
        "report_kind": {"utxo-set"},
        "report_version": {"1.1"},
        "snapshot": {"network": "string", "base_hash": "string", "base_height": "count", "date": "day?", "coins": "count"},
        "totals": {
            **{k: "btc" for k in ("btc", "key_in_output_btc", "hash_only_btc", "other_btc", "dormant_btc", "dormant_key_in_output_btc", "coinbase_p2pk_btc")},
            **{k: "btc?" for k in ("revealed_btc", "exposed_btc", "dormant_exposed_btc")},
            "exposed_share": "share?",
            "coins": "count",
            "coinbase_p2pk_coins": "count",
        },
        "dormancy": {"years": "positive", "created_before_height": "count", "rule": "string"},
        "reuse": ({"start_height": "count", "end_height": "count", "blocks": "count", "inputs": "count", "targets": "count", "revealed": "count"}, None),
        "by_type": (
            "map",
            {
                "script_type": set(S.LABELS),
                "coins": "count",
                "btc": "btc",
                "share_of_supply": "share",
                "key_in_output": "bool",
                "hash_only": "bool",
                "dormant_btc": "btc",
                "revealed_coins": "count?",
                "revealed_btc": "btc?",
            },
        ),
        "age_bins": {"bin_size": "positive", "bins": [{"start_height": "count", "start_date": "day?", "btc_by_type": ("map", "btc"), "revealed_btc_by_type": ("map", "btc")}]},
        "checks": {
            "coins_match_header": "bool",
            "computed_txoutset_hash": "string?",
            "expected_txoutset_hash": "string?",
            "hash_matches": "bool?",
            "base_hash_matches": "bool?",
            "coins_match_node": "bool?",
        },
        "note": "string",
    },
}


def _is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


SCALARS = {
    "string": lambda x: isinstance(x, str),
    "text": lambda x: isinstance(x, str) and x != "",
    "bool": lambda x: isinstance(x, bool),
    "number": _is_number,
    "btc": lambda x: _is_number(x) and x >= 0,
    "share": lambda x: _is_number(x) and 0 <= x <= 1,
    "count": lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= 0,
    "positive": lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= 1,
    "day": lambda x: isinstance(x, str) and re.fullmatch(r"\d{4}-\d{2}-\d{2}", x) is not None,
}


def _problems(value: Any, shape: Any, where: str) -> Iterator[str]:
    if isinstance(shape, str):
        if not (value is None and shape.endswith("?") or SCALARS[shape.rstrip("?")](value)):
            yield f"{where}: {value!r} is not a {shape.rstrip('?')}"
    elif isinstance(shape, set):
        if not isinstance(value, str) or value not in shape:
            yield f"{where}: {value!r} is not one of {', '.join(sorted(shape))}"
    elif isinstance(shape, list):
        if not isinstance(value, list):
            yield f"{where}: {value!r} is not a list"
        else:
            for i, x in enumerate(value):
                yield from _problems(x, shape[0], f"{where}[{i}]")
    elif isinstance(shape, tuple) and shape[0] == "map":
        if not isinstance(value, dict):
            yield f"{where}: {value!r} is not an object"
        else:
            for k, x in value.items():
                yield from _problems(x, shape[1], f"{where}.{k}")
    elif isinstance(shape, tuple):
        if value != shape[1]:
            yield from _problems(value, shape[0], where)
    elif not isinstance(value, dict):
        yield f"{where}: {value!r} is not an object"
    else:
        for k in shape:
            if k not in value:
                yield f"{where}: {k!r} is missing"
            else:
                yield from _problems(value[k], shape[k], f"{where}.{k}")
        for k in value:
            if k not in shape:
                yield f"{where}: {k!r} is not expected"


def _rules(report: dict) -> Iterator[str]:
    """What fields say about each other."""
    if report.get("report_kind") == "exposure":
        for i, a in enumerate(report["addresses"]):
            if a["exposed"] != (a["status"] in (X.VISIBLE, X.SPENT_BEFORE)):
                yield f"report.addresses[{i}]: exposed and status {a['status']!r} disagree"
            if a["status"] == X.SPENT_BEFORE and a["first_spend"] is None:
                yield f"report.addresses[{i}]: spent before, but without a first spend"
    elif report.get("report_kind") is None:
        for i, c in enumerate(report["clusters"]):
            if not c["addresses"]:
                yield f"report.clusters[{i}].addresses: is empty"
        for i, h in enumerate(report["hops"]):
            if not h["reasons"]:
                yield f"report.hops[{i}].reasons: is empty"
        for k, t in report["transactions"].items():
            if len(t["outside_inputs_sample"]) > T.SAMPLE:
                yield f"report.transactions.{k}.outside_inputs_sample: holds more than {T.SAMPLE}"
        for i, e in enumerate(report["entities"]):
            for month, pair in e["outflow_by_month"].items():
                if len(pair) != 2:
                    yield f"report.entities[{i}].outflow_by_month.{month}: is not a low and a high figure"


def kind_of(report: Any) -> str:
    return str(report.get("report_kind", "trace")) if isinstance(report, dict) else "trace"


def validate(report: Any, limit: int = 10) -> list[str]:
    """Readable problems of a report, the first ``limit``; none if it is valid."""
    kind = kind_of(report)
    if kind not in SHAPES:
        return [f"report_kind {kind!r} is not known"]
    if isinstance(report, dict) and "report_version" not in report:
        return [f"the report has no report_version: it is older than this program; make the {kind} report again"]
    if isinstance(report, dict) and report["report_version"] != VERSIONS[kind]:
        return [f"report_version {report['report_version']!r} is not supported; {kind} reports of version {VERSIONS[kind]} are"]
    found = sorted(_problems(report, SHAPES[kind], "report")) or list(_rules(report))
    return found[:limit] + ([f"... and {len(found) - limit} more"] if len(found) > limit else [])


def _btc(sats: int | None) -> float | None:
    return None if sats is None else sats / 100_000_000


def _day(x) -> str | None:
    return None if x is None else x.isoformat()


def _flow(row: Any) -> dict:
    sats = {m: int(row[m]) if m in row else 0 for m in O.MEASURES}
    low, high = sats[O.MEASURES[0]] + sats[O.MEASURES[3]] + sats[O.MEASURES[5]], sats[O.MEASURES[1]] + sats[O.MEASURES[4]] + sats[O.MEASURES[5]]
    return {m: _btc(sats[m]) for m in FLOW if m in sats} | {"spending_txs": int(row["spending_txs"]), "total": _btc(low), "total_core": _btc(high)}


def write_tables(found: T.Trace, path: str, seed_info: DataFrame | None = None) -> None:
    """A trace of any size as Parquet tables under ``path``: what trace_report() lists, without a row passing the driver."""
    full, core = C.two_views(found.links, found.seeds)
    listed = materialize(C.clusters(found.links, found.seeds, full, core), "clusters")
    info = seed_info if seed_info is not None else found.seeds.selectExpr("address", "CAST(NULL AS STRING) sdn_ref", "CAST(NULL AS STRING) sdn_name")
    tables = {n: getattr(found, n) for n in ("transactions", "hops", "coinjoin_stops", "service_stops", "links", "activity", "unexplored")}
    tables |= {"clusters": listed, "members": full.join(core, "address", "left"), "outflow": O.cluster_outflow(found, listed, full, core), "seeds": T.seed_summaries(found)}
    tables |= {"sweeps": O.classify_sweeps(found, full, core), "entities": O.entity_outflow(found, info, full, core), "months": O.entity_months(found, info, full, core)}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def trace_report(found: T.Trace, seed_info: DataFrame | None = None) -> dict:
    """The trace report. It lists every record, so it is for traces that fit a document; write_tables() is for others."""
    spark = found.seeds.sparkSession
    info = seed_info if seed_info is not None else spark.createDataFrame([], "address string, sdn_ref string, sdn_name string")
    names = {r["address"]: r for r in info.join(found.seeds, "address", "left_semi").where("sdn_ref IS NOT NULL").collect()}
    full, core = C.two_views(found.links, found.seeds)
    listed = materialize(C.clusters(found.links, found.seeds, full, core), "clusters")
    flows = {r["cluster"]: r.asDict() for r in O.cluster_outflow(found, listed, full, core).collect()}
    internal = {r["txid"] for r in O.classify_sweeps(found, full, core).where("internal").collect()}
    members: dict[str, list[str]] = {}
    for r in full.collect():
        members.setdefault(r["full"], []).append(r["address"])
    proof: dict[str, list[dict]] = {}
    records = found.links.select("kind", "txid", "height", "batch_sweep", "src").distinct().join(full.withColumnRenamed("address", "src"), "src")
    for r in records.orderBy("height", "txid", "kind").collect():
        proof.setdefault(r["full"], []).append({k: r[k] for k in ("kind", "txid", "height", "batch_sweep")})
    seeds = sorted(r["address"] for r in found.seeds.collect())
    groups = listed.orderBy("cluster").collect()
    cluster_of = {a: (g["cluster"], g["addresses"]) for g in groups for a in members[g["full"]]}
    months: dict[str | None, dict] = {}
    for r in O.entity_months(found, info, full, core).orderBy("month").collect():
        months.setdefault(r["sdn_ref"], {})[r["month"]] = [_btc(r["low"]), _btc(r["high"])]
    entity_names = {r["sdn_ref"]: r["sdn_name"] for r in names.values()}
    sums = [sum(f[m] for f in flows.values() if f["seeds"]) for m in (*O.MEASURES, "spending_txs")]
    total = dict(zip((*O.MEASURES, "spending_txs"), sums, strict=True))
    stop = lambda r: {"depth": r["depth"], "height": r["height"], "date": _day(r["date"]), "txid": r["txid"], "from_addresses": r["spenders"], "traced_value_btc": _btc(r["traced_sats"])}
    p = found.parameters
    return {
        "report_version": VERSIONS["trace"],
        "seeds": seeds,
        "parameters": {k: p[k] for k in ("max_depth", "max_addresses", "start_height", "service_min_inputs")} | {"min_value_btc": _btc(p["min_sats"])},
        "scanned_to_height": found.tip,
        "seed_info": {a: {"sdn_ref": r["sdn_ref"], "sdn_name": r["sdn_name"] or ""} for a, r in sorted(names.items())},
        "seed_summaries": [
            {
                "address": r["address"],
                "sdn_ref": names[r["address"]]["sdn_ref"] if r["address"] in names else None,
                "sdn_name": names[r["address"]]["sdn_name"] if r["address"] in names else None,
                "cluster": cluster_of.get(r["address"], (None, 1))[0],
                "cluster_size": cluster_of.get(r["address"], (None, 1))[1],
                "spending_txs": r["spending_txs"],
                "spent_btc": _btc(r["spent"]),
                "returned_btc": _btc(r["returned"]),
                "net_out_btc": _btc(r["net_out"]),
                "first_spend": _day(r["first_spend"]),
                "last_spend": _day(r["last_spend"]),
                "first_spend_height": r["first_spend_height"],
                "last_spend_height": r["last_spend_height"],
            }
            for r in T.seed_summaries(found).collect()
        ],
        "outflow_total": _flow(total) if flows else {},
        "entities": [
            {
                "sdn_ref": r["sdn_ref"],
                "sdn_name": entity_names.get(r["sdn_ref"]),
                "seeds": r["seeds"],
                "clusters": r["clusters"],
                "cluster_addresses": r["cluster_addresses"],
                "outflow": _flow(r.asDict()),
                "outflow_by_month": months.get(r["sdn_ref"], {}),
            }
            for r in O.entity_outflow(found, info, full, core).orderBy("sdn_ref").collect()
        ],
        "levels": found.levels,
        "transactions": {
            r["txid"]: {
                "height": r["height"],
                "date": _day(r["date"]),
                "input_addresses": r["all_inputs"],
                "outside_inputs": r["outside"],
                "outside_inputs_sample": r["sample"] or [],
                "outputs": r["n_out"],
                "batch_sweep": r["batch_sweep"],
            }
            for r in found.transactions.orderBy("height", "txid").collect()
        },
        "hops": [
            {
                "depth": r["depth"],
                "height": r["height"],
                "date": _day(r["date"]),
                "txid": r["txid"],
                "from_addresses": r["spenders"],
                "vout": r["n"],
                "to_address": r["address"],
                "value_btc": _btc(r["sats"]),
                "label": r["label"],
                "reasons": r["reasons"],
                "followed": r["followed"],
            }
            for r in found.hops.orderBy("depth", "ord", "n").collect()
        ],
        "coinjoin_stops": [stop(r) for r in found.coinjoin_stops.orderBy("depth", "ord").collect()],
        "service_stops": [
            stop(r)
            | {
                "input_addresses": r["all_inputs"],
                "outside_inputs": r["outside"],
                "outputs": [{"address": o["address"], "value_btc": _btc(o["sats"])} for o in r["outputs"] or ()],
                "classification": INTERNAL if r["txid"] in internal else SERVICE,
            }
            for r in found.service_stops.orderBy("depth", "ord").collect()
        ],
        "clusters": [
            {
                "addresses": sorted(members[g["full"]]),
                "seeds": sorted(set(members[g["full"]]) & set(seeds)),
                "evidence": proof.get(g["full"], []),
                "batch_links": g["batch_links"],
                "size_without_batch_sweeps": g["size_without_batch_sweeps"],
                "outflow": _flow(flows[g["cluster"]]) if g["cluster"] in flows else None,
            }
            for g in groups
        ],
        "unexplored": sorted(r["address"] for r in found.unexplored.collect()),
        "truncated": found.truncated,
        "note": NOTE,
    }


def _sums(r: Any) -> dict:
    return {k: r[k] for k in ("addresses", "funded_addresses", "exposed_addresses")} | {"balance_btc": _btc(r["balance"]), "exposed_btc": _btc(r["exposed"]), "hash_only_btc": _btc(r["hash_only"])}


def exposure_report(rows: DataFrame, snapshot: dict, candidate_blocks: int = 0) -> dict:
    rows = rows.persist()
    try:
        by_type = {r["script_type"]: r for r in X.exposure_by_type(rows).collect()}
        return {
            "report_kind": "exposure",
            "report_version": VERSIONS["exposure"],
            "snapshot": snapshot,
            "totals": _sums(X.exposure_totals(rows).first()),
            "by_type": {S.LABELS.get(k, k): _sums(by_type[k]) for k in sorted(by_type)},
            "by_entry": [{"sdn_ref": r["sdn_ref"], "sdn_name": r["sdn_name"]} | _sums(r) for r in X.exposure_by_entry(rows).collect()],
            "addresses": [
                {
                    "address": r["address"],
                    "script_type": r["script_type"],
                    "sdn_ref": r["sdn_ref"],
                    "sdn_name": r["sdn_name"],
                    "balance_btc": _btc(r["sats"]),
                    "utxos": r["utxos"],
                    "oldest_utxo_height": r["oldest_height"],
                    "status": r["status"],
                    "exposed": r["exposed"],
                    "first_spend": None if r["first_txid"] is None else {"height": r["first_height"], "date": _day(r["first_day"]), "txid": r["first_txid"]},
                }
                for r in rows.withColumn("first_day", S.to_day(F.col("first_time"))).orderBy(F.desc("sats"), "address").collect()
            ],
            "candidate_blocks": candidate_blocks,
            "blocks_checked": candidate_blocks,
            "note": NOTE,
        }
    finally:
        rows.unpersist()


def utxo_report(marked: DataFrame, snapshot: dict, checks: dict, bin_size: int = 1000, years: int = 5, blocks_per_year: int = 52560, reuse: dict | None = None, dates: dict[int, str] | None = None) -> dict:
    """The report of coins with script_type, bin and revealed; without ``reuse`` every revealed and exposed figure is null."""
    measured = reuse is not None
    tip, old = snapshot["base_height"], years * blocks_per_year
    t = U.totals(marked, bin_size, old, measured, tip).first().asDict()
    cells = marked.groupBy("script_type", "bin").agg(F.count("*").alias("coins"), F.sum("sats").alias("sats"), F.count_if("revealed").alias("r_coins"), F.coalesce(F.sum(F.when(F.col("revealed"), F.col("sats"))), F.lit(0)).alias("r_sats")).collect()
    kinds: dict[str, dict] = {}
    bins: dict[int, dict[str, dict]] = {}
    for c in cells:
        k = kinds.setdefault(c["script_type"], {"coins": 0, "sats": 0, "old": 0, "r_coins": 0, "r_sats": 0})
        for f in ("coins", "sats", "r_coins", "r_sats"):
            k[f] += c[f]
        k["old"] += c["sats"] if (c["bin"] + 1) * bin_size <= tip - old else 0
        b = bins.setdefault(c["bin"], {"all": {}, "revealed": {}})
        b["all"][c["script_type"]] = _btc(c["sats"])
        if measured and c["r_coins"]:
            b["revealed"][c["script_type"]] = _btc(c["r_sats"])
    supply = t["sats"]
    share = lambda x: x / supply if supply else 0.0
    return {
        "report_kind": "utxo-set",
        "report_version": VERSIONS["utxo-set"],
        "snapshot": snapshot,
        "totals": {
            "coins": t["coins"],
            "btc": _btc(supply),
            **{f"{k}_btc": _btc(t[k]) for k in ("key_in_output", "hash_only", "other", "revealed", "exposed", "dormant", "dormant_key_in_output", "dormant_exposed", "coinbase_p2pk")},
            "exposed_share": share(t["exposed"]) if measured else None,
            "coinbase_p2pk_coins": t["coinbase_p2pk_coins"],
        },
        "dormancy": {"years": years, "created_before_height": max(tip - old, 0), "rule": f"coins created at least {old:,} blocks ({years} years at 10 minutes a block) before the snapshot, in whole {bin_size:,}-block bins"},
        "reuse": reuse,
        "by_type": {
            S.LABELS.get(name, name): {
                "script_type": name,
                "coins": k["coins"],
                "btc": _btc(k["sats"]),
                "share_of_supply": share(k["sats"]),
                "key_in_output": name in S.KEY_IN_OUTPUT,
                "hash_only": name in S.HASH_ONLY,
                "dormant_btc": _btc(k["old"]),
                "revealed_coins": k["r_coins"] if measured and name in S.HASH_ONLY else None,
                "revealed_btc": _btc(k["r_sats"]) if measured and name in S.HASH_ONLY else None,
            }
            for name, k in sorted(kinds.items(), key=lambda x: (-x[1]["sats"], x[0]))
        },
        "age_bins": {
            "bin_size": bin_size,
            "bins": [{"start_height": b * bin_size, "start_date": (dates or {}).get(b * bin_size), "btc_by_type": dict(sorted(v["all"].items())), "revealed_btc_by_type": dict(sorted(v["revealed"].items()))} for b, v in sorted(bins.items())],
        },
        "checks": checks,
        "note": NOTE,
    }
