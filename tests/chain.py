"""Small ledgers in memory: blocks as the decoded JSON that a node gives."""

import json

BASE_TIME = 1577836800


def tx(txid, ins, outs):
    """ins: (address, btc[, type]); outs: the same, address None for a data output."""
    kind = lambda x: x[2] if len(x) > 2 else "witness_v0_keyhash"
    script = lambda x: {"type": "nulldata"} if x[0] is None else {"address": x[0], "type": kind(x)}
    vin = [{"txid": f"prev-{txid}-{i}", "vout": i, "prevout": {"value": x[1], "scriptPubKey": script(x)}} for i, x in enumerate(ins)]
    return {"txid": txid, "vin": vin, "vout": [{"n": n, "value": x[1], "scriptPubKey": script(x)} for n, x in enumerate(outs)]}


def coinbase(txid, outs):
    return tx(txid, [], outs) | {"vin": [{"coinbase": "00"}]}


def ledger(spark, tmp_path, blocks, times=True):
    """blocks: {height: [tx, ...]}"""
    from ledgerflow.sources.decoded import ledger_of, read_blocks

    path = tmp_path / "blocks.json"
    lines = [json.dumps({"hash": f"{h:064d}", "height": h, "time": BASE_TIME + h * 86400 if times else None, "tx": txs}) for h, txs in sorted(blocks.items())]
    path.write_text("\n".join(lines) + '\n{"hash": "cut o')
    return ledger_of(read_blocks(spark, str(path)))


def seeds(spark, *addresses):
    return spark.createDataFrame([(a,) for a in addresses], "address string")
