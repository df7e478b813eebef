"""Physical plans, the stream, and the driver contract."""

import re

import pytest

import __spark_entry__
from ledgerscope.operators import windows
from ledgerscope.plans import queries
from ledgerscope.streaming.volumes import tumbling_volumes

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(queries.SQL) <= set(queries.QUERIES) and set(queries.QUERIES) <= set(__spark_entry__.queries())


def test_entry_returns_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["ls62_total_volume", "ls69_concentration", "ls65_active_addresses"])
def test_no_cartesian_product(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_scan_and_block_ranges_reach_the_newest_block(spark):
    sf = "/root/testdata/sf0.01"
    newest = spark.read.parquet(f"{sf}/lineitem.parquet").agg({"l_orderkey": "max"}).collect()[0][0]
    assert newest > 9000
    logs = __spark_entry__.queries()["ls07_log_scan_newest"](spark, sf).collect()
    assert sum(r.n for r in logs) == spark.read.parquet(f"{sf}/lineitem.parquet").count() and max(r.last_block for r in logs) == newest
    assert max(r.last_block for r in __spark_entry__.queries()["ls43_block_ranges_newest"](spark, sf).collect()) > 9000


def test_all_months_hold_every_transfer(spark):
    placed = __spark_entry__.queries()["ls42_assign_windows"](spark, SF).agg({"n": "sum"}).collect()[0][0]
    assert placed == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert windows.months_of(spark.createDataFrame([], "block_time timestamp")).count() == 0


@pytest.mark.parametrize("name", ["ls39_participation_predicate", "ls42_assign_windows", "ls63_unclassified", "ls65_active_addresses"])
def test_facts_meet_their_months_by_an_equal_key(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("select timestamp '2026-06-01 00:00:00' + make_interval(0,0,0,0,id*5) as block_time, concat('a', id % 2) as asset_uid, cast(id as double) as amount from range(40)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = tumbling_volumes(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("volumes").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("volumes").collect())) == sorted(map(tuple, tumbling_volumes(rows).collect()))


@pytest.mark.parametrize("name", ["ls76_report", "ls79_report_rows", "ls68_dormancy", "ls82_panel_activity", "monthly_turnover", "ls66_volume_per_active", "ls67_active_holder_ratio", "ls46_implausible", "ls47_dropped_counts"])
def test_the_ledger_is_joined_once(spark, monkeypatch, name):
    joined, transfers = [], queries.fx.transfers
    monkeypatch.setattr(queries.fx, "transfers", lambda *a: joined.append(a) or transfers(*a))
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(joined) == 1 and "l_orderkey" not in plan


def test_the_ledger_is_joined_alike_at_every_size(spark):
    plan = queries.fx.transfers(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("name", ["ls08_saved_query_transfers", "ls11_saved_query_holders"])
def test_pages_are_read_and_parsed_once(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "collect_list" not in plan


def test_pages_stay_as_they_are_when_the_ledger_grows(spark, monkeypatch):
    seen, read = [], queries.payloads.saved_query_transfers
    monkeypatch.setattr(queries.payloads, "saved_query_transfers", lambda pages, chain: seen.append(pages.count()) or read(pages, chain))
    for sf in (SF, "/root/testdata/sf0.01"):
        queries.ls08_saved_query_transfers(spark, sf)
    assert seen == [50, 500]


@pytest.mark.parametrize("name", ["ls45_log_decode", "ls45_wide_amounts"])
def test_logs_are_decoded_without_regular_expressions(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rlike" not in plan


def test_the_ledger_is_joined_without_sorting(spark):
    plan = queries.fx.transfers(spark, SF).select("asset_uid", "block_time", "from_address", "to_address", "amount")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["ls69_concentration", "ls83_participation", "ls87_figures"])
def test_the_join_moves_small_numbers_only(spark, monkeypatch, name):
    """Not the texts, keys and line numbers that they are made of, nor the prices, which these queries do not ask for."""
    plans, settle = [], queries.settled
    monkeypatch.setattr(queries, "settled", lambda rows: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or settle(rows))
    monkeypatch.setattr(queries.fx, "settled", queries.settled)
    queries.QUERIES[name](spark, SF)
    plan = next(p for p in plans if "l_orderkey" in p)
    lines = plan.splitlines()
    moved = lines[next(k for k, x in enumerate(lines) if "Join Inner" in x and "l_orderkey" in x) + 1]
    assert set(re.findall(r"(?:\[|, )(l_\w+)#\d+L?(?=, |\])", moved)) == {"l_orderkey", "l_quantity", "l_shipdate"} and "l_extendedprice" not in moved, moved


def test_rows_in_order_are_moved_once(spark):
    """Where the whole rows are moved for ``seq``, the numbers made of them are not moved beside them."""
    plan = queries.fx.transfers(spark, SF, False).select("asset_uid", "from_address", "amount", "seq")._jdf.queryExecution().optimizedPlan().toString()
    assert "asset#" not in plan[plan.index("Join Inner") :] and "kind#" not in plan[plan.index("Join Inner") :]
