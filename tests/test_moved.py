"""What the ledger queries move between executors and send to the driver, on the smallest tables."""

import json

import pyarrow as pa
import pytest
from chain import coinbase, tx

import __spark_entry__ as entry
from ledgerflow.functions import reveal
from ledgerflow.sources import decoded, rawblocks

DATA = "/root/testdata/sf0.001"


def _settled(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()


def shuffled(spark, query):
    """Bytes shuffled per line item, when no table is small enough for a broadcast."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: sum(s.shuffleWriteBytes() for s in _stages(spark, store))
    _settled(spark)
    before = stages()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        entry.queries()[query](spark, DATA).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    _settled(spark)
    return (stages() - before) / spark.read.parquet(f"{DATA}/lineitem.parquet").count()


def _stages(spark, store):
    gateway = spark.sparkContext._gateway
    found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]


def broadcasts(spark, query):
    """Executions of a query, as they ran, that broadcast a table."""
    store = spark._jsparkSession.sharedState().statusStore()
    _settled(spark)
    before = store.executionsCount()
    entry.queries()[query](spark, DATA).write.format("noop").mode("overwrite").save()
    _settled(spark)
    ran = store.executionsList(int(before), 10_000)
    plans = [ran.apply(i).physicalPlanDescription() for i in range(ran.size())]
    assert plans
    return [p for p in plans if "BroadcastExchange" in p]


# 643 bytes a line before transactions were moved whole, by key
@pytest.mark.parametrize("query", ["hops_depth1", "hops_depth2", "level_stats"])
def test_trace_moves_a_transaction_once_a_level(spark, query):
    assert shuffled(spark, query) < 250


@pytest.mark.parametrize("query", ["seed_summary", "cluster_summary", "cluster_outflow", "outflow_total", "entity_outflow", "entity_month", "top_destinations"])
def test_trace_sends_no_table_to_the_driver(spark, query):
    assert not broadcasts(spark, query)  # 16 to 18 tables of a trace before


@pytest.mark.parametrize("query", ["change_labels", "output_label_counts", "common_input_clusters"])
def test_lines_move_once_as_numbers(spark, query):
    assert shuffled(spark, query) < 60  # 194 to 299 before


@pytest.mark.parametrize("query", ["decoded_inputs", "decoded_outputs", "decoded_transactions"])
def test_blocks_are_made_of_numbers(spark, query):
    assert shuffled(spark, query) < 90


def test_coinbases_are_left_out_by_block(spark, tmp_path):
    chain = {1: [coinbase("cb", [("A", 50.0)]), tx("a", [("A", 3.0), ("B", 1.0)], [("C", 3.9)])], 2: [coinbase("cb2", [("A", 50.0)])]}
    path = tmp_path / "blocks.json"
    path.write_text("\n".join(json.dumps({"hash": f"{h:064d}", "height": h, "time": h, "tx": txs}) for h, txs in chain.items()))
    rows = decoded.ledger_of(decoded.without_coinbases(decoded.read_blocks(spark, str(path)))).tx_in
    assert sorted((r["txid"], r["in_index"], r["address"]) for r in rows.collect()) == [("a", 0, "A"), ("a", 1, "B")]


@pytest.mark.parametrize("query", ["witness_programs", "spend_forms"])
def test_blocks_are_read_and_hashed_by_one_worker_a_task(spark, query):
    plan = entry.queries()[query](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # 2 before


def test_a_large_block_leaves_the_worker_in_parts():
    raw = b"\0" * 80 + b"\2" + _transaction(1) + _transaction(12_000)
    schema = pa.schema([("height", pa.int32()), ("tx_index", pa.int32()), ("in_index", pa.int32()), ("script_sig", pa.binary()), ("witness", pa.list_(pa.binary()))])
    blocks = pa.RecordBatch.from_pylist([{"height": 7, "raw": raw}], pa.schema([("height", pa.int32()), ("raw", pa.binary())]))
    parts = list(rawblocks._in_parts(rawblocks._inputs(iter([blocks])), schema))
    assert max(p.num_rows for p in parts) <= rawblocks.ROWS and sum(p.num_rows for p in parts) == 12_000
    with pytest.raises(ValueError, match="ends early"):
        list(rawblocks.block_inputs(raw[:-1]))


def _transaction(inputs):
    return b"\2\0\0\0" + b"\xfd" + inputs.to_bytes(2, "little") + (b"\7" * 36 + b"\0" + b"\xff" * 4) * inputs + b"\1" + b"\0" * 8 + b"\0" + b"\0" * 4


def test_a_compressed_key_is_hashed_once_a_kind_of_address(monkeypatch):
    hashed = []
    monkeypatch.setattr(reveal, "hash160", lambda data: hashed.append(data) or bytes(20))
    assert len(reveal.of_key(b"\2" + b"\1" * 32)) == 2 and len(hashed) == 2  # 3 before
