"""Three CSV files through all measures: the worked example, with holders A 500, B 250, C 150, D 60, E 40 of a supply of 1000."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerscope.functions.classify import classify
from ledgerscope.operators import report, status, windows
from ledgerscope.schemas import DEAD, ZERO
from ledgerscope.sources import tables

UID, OTHER = "eth:0xt", "eth:0xq"
ENVELOPE = "node,2026-07-01T00:00:00+00:00"


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sample")
    moves = [(5, ZERO, "a", 400), (6, ZERO, "b", 200), (7, "a", "c", 100), (8, "c", "d", 60), (9, "e", ZERO, 25), (10, DEAD, ZERO, 15)]
    rows = [f"{a},0x{d},{d},2026-06-{d:02d}T02:00:00+02:00,{t},{f},{x},{2 * x},secondary,{ENVELOPE}" for a in (UID,) for d, f, t, x in moves]
    rows.append(f"{UID},0x1,0,2026-05-02T00:00:00+00:00,b,a,999,1998,secondary,{ENVELOPE}")
    (folder / "transfer_events.csv").write_text("\n".join(["asset_uid,tx_hash,log_index,block_time,to_address,from_address,amount,amount_usd,kind,source,retrieved_at", *rows]))
    held = [f"{x},{a},2026-07-01T00:00:00+00:00,{ENVELOPE},{UID},{2 * x}" for a, x in (("a", 500), ("b", 250), ("c", 150), ("d", 60), ("e", 40))]
    (folder / "holder_balances.csv").write_text("\n".join(["balance,address,as_of,source,retrieved_at,asset_uid,balance_usd", *held]))
    snaps = [f"{UID},TOK,Token,6,1000,2000,2,5,2026-06-30T00:00:00+00:00,{ENVELOPE}", f"{OTHER},OTH,Other,6,,,,,2026-06-30T00:00:00+00:00,{ENVELOPE}"]
    (folder / "asset_snapshots.csv").write_text("\n".join(["asset_uid,symbol,name,decimals,total_supply,market_value_usd,price_usd,holder_count,as_of,source,retrieved_at", *snaps]))
    return tables.load_dataset(spark, str(folder))


def inputs(spark, dataset, **status_of):
    none = spark.createDataFrame([], "asset_uid string, address string")
    rows = [(UID, status_of.get("missing", []), status_of.get("checked", True), status_of.get("reconciled", True))]
    state = spark.createDataFrame(rows, "asset_uid string, missing_kinds array<string>, reconciliation_checked boolean, reconciled boolean")
    return report.Inputs(classify(dataset.transfers, none), dataset.holders, dataset.snapshots, none, state)


@pytest.fixture(scope="module")
def june(spark):
    return windows.months(spark, "2026-06", "2026-06")


@pytest.mark.parametrize(
    ("mode", "turnover", "per_active", "ratio", "dormancy"),
    [("secondary_only", 0.16, 160 / 3, 0.6, 0.29), ("primary_only", 0.625, 625 / 3, 0.6, 0.21), ("all", 0.8, 160.0, 1.0, 0.0)],
)
def test_worked_example(spark, dataset, june, mode, turnover, per_active, ratio, dormancy):
    r = {x.asset_uid: x for x in report.build_report(inputs(spark, dataset), june, mode).collect()}
    got = r[UID]
    assert (got.turnover, got.volume_per_active, got.active_holder_ratio, got.dormancy) == pytest.approx((turnover, per_active, ratio, dormancy))
    assert (got.top_share, got.hhi, got.coverage, got.conditional_hhi, got.conditional_top_share) == pytest.approx((1.0, 3402.0, 1.0, 3402.0, 1.0))
    assert r[OTHER].turnover is None and r[OTHER].symbol == "OTH" and r[OTHER].dormancy is None


def test_usd_turnover_agrees(spark, dataset, june):
    got = [x for x in report.build_report(inputs(spark, dataset), june, denomination="usd").collect() if x.asset_uid == UID]
    assert got[0].turnover == pytest.approx(0.16)


def test_unmeasured_withheld_and_unverified_are_apart(spark, dataset, june):
    one = lambda **s: next(x for x in report.build_report(inputs(spark, dataset, **s), june).collect() if x.asset_uid == UID)
    unmeasured, withheld, unverified = one(missing=["holders"]), one(reconciled=False), one(reconciled=None)
    assert unmeasured.turnover is None and unmeasured.hhi is None and "missing:holders" in unmeasured.warnings
    assert withheld.turnover == pytest.approx(0.16) and all(withheld[m] is None for m in report.HOLDER_MEASURES) and "withheld" in withheld.warnings
    assert unverified.hhi == pytest.approx(3402) and "unverified" in unverified.warnings


def test_shares_are_of_the_holders_that_are_left(spark, dataset, june):
    lists = spark.createDataFrame([(UID, "A")], "asset_uid string, address string")
    none = dataset.snapshots.withColumn("total_supply", F.lit(None).cast("double"))
    base = inputs(spark, dataset)
    got = next(x for x in report.build_report(report.Inputs(base.transfers, base.holders, none, lists, base.status), june).collect() if x.asset_uid == UID)
    assert got.coverage == pytest.approx(1.0) and got.top_share == pytest.approx(1.0)
    assert got.hhi == pytest.approx(10_000 * (250**2 + 150**2 + 60**2 + 40**2) / 500**2)
    assert {"supply_from_holders", "truncated_holder_list"} <= set(got.warnings)


def test_export_and_trend(spark, dataset):
    w = windows.months(spark, "2026-05", "2026-06")
    out = report.build_report(inputs(spark, dataset), w)
    blocks = spark.createDataFrame([("2026-05", 1, 5, 9), ("2026-06", 6, 9, 9)], "window_id string, first_block long, last_block long, head_block long")
    dropped = spark.createDataFrame([(UID, 2)], "asset_uid string, dropped long")
    rows = report.export_rows(out, status.contributing_sources(dataset.transfers, dataset.holders), w, blocks, dropped).collect()
    assert [(r.asset_uid, r.window_id) for r in rows] == [(OTHER, "2026-05"), (OTHER, "2026-06"), (UID, "2026-05"), (UID, "2026-06")]
    last = rows[-1]
    assert (last.start_block, last.end_block, last.head_block, last.dropped_transfers, last.sources) == (6, 9, 9, 2, "node")
    assert last.window_start.replace(tzinfo=dt.timezone.utc) == dt.datetime(2026, 6, 1, tzinfo=dt.timezone.utc) and rows[0].dropped_transfers is None
    trend = {(r.metric, r.window_id): r for r in report.build_trend(out.filter(F.col("asset_uid") == UID), w).collect()}
    assert trend["turnover", "2026-05"].value is None and trend["turnover", "2026-06"].direction == "insufficient data"
