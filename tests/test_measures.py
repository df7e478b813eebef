"""The worked example, by hand: holders A 500, B 250, C 150, D 60, E 40 of a supply of 1000."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import asof, ledger, measures, panel, reconcile, report, windows
from ledgerscope.schemas import DEAD, ZERO

UID = "eth:0x1"


def at(day, month=6):
    return dt.datetime(2026, month, day, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def june(spark):
    return windows.months(spark, "2026-06", "2026-06")


@pytest.fixture(scope="module")
def holders(spark, june):
    rows = [(UID, "2026-06", a, b) for a, b in (("a", 500.0), ("b", 250.0), ("c", 150.0), ("d", 60.0), ("e", 40.0))]
    return spark.createDataFrame(rows, "asset_uid string, window_id string, address string, balance double")


def supply(spark, n=1000.0):
    return spark.createDataFrame([(UID, "2026-06", n)], "asset_uid string, window_id string, denominator double")


def nobody(spark):
    return spark.createDataFrame([], "asset_uid string, address string")


@pytest.mark.parametrize(("n", "share"), [(1, 0.5), (2, 0.75), (3, 0.9), (5, 1.0)])
def test_top_share_and_hhi(spark, holders, n, share):
    r = measures.concentration(measures.prepare_holders(holders, nobody(spark)), supply(spark), n).collect()[0]
    assert r.top_share == pytest.approx(share)
    assert r.hhi == pytest.approx(3402)


def test_pool_is_excluded_and_identities_hold(spark):
    rows = [(UID, "2026-06", "pool", 200.0), (UID, "2026-06", "a", 100.0)]
    h = spark.createDataFrame(rows, "asset_uid string, window_id string, address string, balance double")
    pool = spark.createDataFrame([(UID, "POOL")], "asset_uid string, address string")
    r = measures.concentration(measures.prepare_holders(h, pool), supply(spark, 300.0)).collect()[0]
    assert r.hhi == pytest.approx(1111.1111, abs=1e-3)
    assert r.conditional_hhi == pytest.approx(10000)
    assert r.hhi == pytest.approx(r.coverage**2 * r.conditional_hhi)
    assert r.top_share == pytest.approx(r.coverage * r.conditional_top_share)


def test_impossible_share_is_null(spark, holders):
    r = measures.concentration(measures.prepare_holders(holders, nobody(spark)), supply(spark, 100.0)).collect()[0]
    assert r.top_share is None and r.hhi is None and "impossible_share" in r.warnings


def test_volumes_are_zero_not_null_when_measured(spark, june):
    none = spark.createDataFrame([], "asset_uid string, window_id string, kind string, amount double, amount_usd double")
    rows = measures.volumes(none, spark.createDataFrame([(UID, "2026-06")], "asset_uid string, window_id string")).collect()
    assert len(rows) == 3 and all(r.volume_native == 0.0 and r.volume_usd == 0.0 for r in rows)


def test_months_tile_and_reversed_range_is_refused(spark):
    w = windows.months(spark, "2025-12", "2026-02").orderBy("start").collect()
    assert [x.window_id for x in w] == ["2025-12", "2026-01", "2026-02"] and w[0].end == w[1].start
    with pytest.raises(ValueError, match="before"):
        windows.months(spark, "2026-02", "2026-01")


def test_latest_snapshot_field_by_field(spark, june):
    rows = [(UID, "x", at(1), 10.0, None), (UID, "y", at(5), None, 7.0), (UID, "a", at(5), None, 8.0), (UID, "z", at(2, 7), 99.0, None)]
    s = spark.createDataFrame(rows, "asset_uid string, source string, as_of timestamp, total_supply double, price_usd double")
    r = asof.latest_snapshot(s, june).collect()
    assert [(x.total_supply, x.price_usd) for x in r] == [(10.0, 7.0)]


def _ledger(spark, rows):
    return spark.createDataFrame([(UID, "all", k, f, t, float(x), at(1 + k)) for k, (f, t, x) in enumerate(rows)], "asset_uid string, bucket string, seq int, from_address string, to_address string, amount double, block_time timestamp")


def test_ledger_replay(spark):
    t = _ledger(spark, [(ZERO, "a", 500), ("a", "b", 150), ("b", ZERO, 50), ("a", "b", 0)])
    instants = spark.createDataFrame([(at(2),), (at(28),)], "as_of timestamp")
    got = {(r.as_of.day, r.address): r.balance for r in ledger.balances_at(t, instants).collect()}
    assert got == {(2, "a"): 500, (28, "a"): 350, (28, "b"): 100}
    assert {r.as_of.day: r.total_supply for r in ledger.supply_at(t, instants).collect()} == {2: 500, 28: 450}
    ok = spark.createDataFrame([(UID, 450.0)], "asset_uid string, total_supply double")
    assert ledger.reconcile_ledger(t, ok).collect()[0].reconciled is True


def _replay(rows):
    supply, out = 0.0, []
    for f, t, x in rows:
        mint, burn = f in (ZERO, DEAD), t in (ZERO, DEAD)
        drop = not mint and x > supply
        if mint:
            supply += x
        elif burn and not drop:
            supply -= x
        out.append(drop)
    return out


def test_implausible_transfers_equal_a_plain_replay(spark):
    import random

    rng = random.Random(3)
    cases = {f"eth:0x{k}": [(rng.choice([ZERO, "a", "b"]), rng.choice([DEAD, "a", "b"]), rng.randint(1, 90)) for _ in range(40)] for k in range(12)}
    rows = [(u, str(i // 7), i, f, t, float(x)) for u, ls in cases.items() for i, (f, t, x) in enumerate(ls)]
    df = spark.createDataFrame(rows, "asset_uid string, bucket string, seq int, from_address string, to_address string, amount double")
    got = {}
    for r in ledger.drop_implausible(df).orderBy("seq").collect():
        got.setdefault(r.asset_uid, []).append(r.dropped)
    assert got == {u: _replay(ls) for u, ls in cases.items()}
    assert any(any(x) for x in got.values())


def test_panel_activity_decomposition(spark):
    w = windows.months(spark, "2026-08", "2026-08")
    rows = [(UID, "2026-08", c, x) for c, x in (("creation", 20.0), ("issuer_linked", 20.0), ("residual", 10.0))]
    placed = spark.createDataFrame(rows, "asset_uid string, window_id string, category string, amount double")
    grid = panel.skeleton(spark.createDataFrame([(UID,)], "asset_uid string"), w)
    z = spark.createDataFrame([(UID, "2026-08", 100.0)], "asset_uid string, window_id string, total_supply double")
    r = panel.activity(placed, grid, z).collect()[0]
    assert (r.v_all, r.t_all, r.t_res, r.f, r.x) == pytest.approx((50.0, 0.5, 0.1, 5.0, 0.8))


@pytest.mark.parametrize(("values", "word"), [([1.0], "insufficient data"), ([0.0, 0.0], "flat at zero"), ([0.0, 2.0], "rising from zero"), ([1.0, 1.2], "rising"), ([1.0, 0.5], "falling"), ([1.0, 1.05], "flat")])
def test_direction(spark, values, word):
    df = spark.createDataFrame([(UID, "m", k, v) for k, v in enumerate(values)], "asset_uid string, metric string, start int, value double")
    assert report.direction(df).collect()[0].direction == word


def test_reconcile_is_symmetric(spark):
    rows = [(UID, "a", at(1), 100.0), (UID, "b", at(4), 297.3)]
    s = spark.createDataFrame(rows, "asset_uid string, source string, as_of timestamp, total_supply double")
    r = reconcile.comparisons(reconcile.long_fields(s)).collect()[0]
    assert r.relative_difference == pytest.approx(0.66364, abs=1e-4) and r.stale and r.gap_hours == 72
    assert "too far apart" in reconcile.describe(reconcile.comparisons(reconcile.long_fields(s))).collect()[0].description
    assert F is not None


def _odd_ledger(spark, rows):
    df = spark.createDataFrame([(u, str(i // 3), i, f, t, x) for u, ls in rows.items() for i, (f, t, x) in enumerate(ls)], "asset_uid string, bucket string, seq int, from_address string, to_address string, amount double")
    return df


@pytest.mark.parametrize("lot_rows", [1, 5, 1000])
def test_a_busy_asset_is_replayed_in_lots(spark, lot_rows):
    import random

    rng = random.Random(5)
    cases = {f"eth:0x{k}": [(rng.choice([ZERO, "a", "b"]), rng.choice([DEAD, DEAD, "a"]), float(rng.randint(1, 90))) for _ in range(30)] for k in range(4)}
    got = {}
    for r in ledger.drop_implausible(_odd_ledger(spark, cases), lot_rows=lot_rows).orderBy("seq").collect():
        got.setdefault(r.asset_uid, []).append(r.dropped)
    assert got == {u: _replay(ls) for u, ls in cases.items()} and any(any(x) for x in got.values())


def test_amounts_beyond_numbers_are_dropped_and_never_added(spark):
    quiet = [(ZERO, "a", 10.0), ("a", "b", None), ("a", DEAD, None), ("a", "b", 10.0), (ZERO, "a", None), ("a", "b", 11.0)]
    busy = [("a", DEAD, 5.0), *quiet]  # the burn comes before any supply, so this one is replayed
    rows = ledger.drop_implausible(_odd_ledger(spark, {"eth:0x1": quiet, "eth:0x2": busy}), lot_rows=2).orderBy("asset_uid", "seq").collect()
    want = [False, True, True, False, False, True]
    assert [r.dropped for r in rows] == want + [True] + want
    counts = ledger.dropped_counts(ledger.drop_implausible(_odd_ledger(spark, {"eth:0x1": quiet})), spark.createDataFrame([("eth:0x1",), ("eth:0x9",)], "asset_uid string"))
    assert {r.asset_uid: r.dropped for r in counts.collect()} == {"eth:0x1": 3, "eth:0x9": 0}


def test_a_transfer_above_todays_supply_is_kept(spark):
    rows = ledger.drop_implausible(_odd_ledger(spark, {UID: [(ZERO, "a", 1000.0), ("a", "b", 900.0), ("b", ZERO, 950.0)]}))
    assert not any(r.dropped for r in rows.collect())


def test_overflowed_logs_are_dropped_end_to_end(spark):
    word = lambda n: f"0x{n:064x}"
    log = lambda k, f, t, n: (UID, [ledger.TRANSFER_TOPIC, word(f), word(t)], word(n), hex(k), hex(0), f"0x{k}", hex(1_780_000_000 + k))
    raw = spark.createDataFrame([log(1, 0, 10, 1000), log(2, 10, 11, 11 * 10**39), log(3, 10, 11, 7)], "asset_uid string, topics array<string>, data string, blockNumber string, logIndex string, transactionHash string, blockTimestamp string")
    t = ledger.decode_logs(raw).withColumn("bucket", F.lit(0)).withColumnRenamed("raw", "amount")
    got = ledger.drop_implausible(t, seq="block").orderBy("block").collect()
    assert [r.dropped for r in got] == [False, True, False] and [r.overflow for r in got] == [False, True, False]


def test_dormancy_is_null_where_no_holder_is_left(spark, holders):
    none = spark.createDataFrame([], "asset_uid string, window_id string, mode string, address string")
    one = spark.createDataFrame([(UID, "2026-06", "all", "a"), (UID, "2026-06", "all", "c"), (UID, "2026-06", "all", "d")], none.schema)
    assert measures.dormancy(holders, one, supply(spark)).collect()[0].dormancy == pytest.approx(0.29)
    assert measures.dormancy(holders, none, supply(spark)).collect()[0].dormancy == pytest.approx(1.0)
    assert measures.dormancy(holders.limit(0), one, supply(spark)).collect()[0].dormancy is None


def test_windows_of_equal_length_are_found_by_their_number(spark):
    w = windows.windows_ending(spark, "2026-06-30", 7, 3)
    facts = spark.createDataFrame([(at(8),), (at(9),), (at(15),), (at(16),), (at(29),), (at(30),)], "block_time timestamp")
    got = sorted((r.block_time.day, r.window_id) for r in windows.assign(facts, w).collect())
    slow = sorted((r.block_time.day, r.window_id) for r in windows.assign(facts, w.select("window_id", "start", "end")).collect())
    assert got == slow == [(9, "2026-06-16"), (15, "2026-06-16"), (16, "2026-06-23"), (29, "2026-06-30")]


@pytest.mark.parametrize(("value", "text"), [(1234.5, "1,234"), (1e9, "1,000,000,000"), (999.96, "1000"), (12.5, "12.5"), (0.123456, "0.1235"), (0.0, "0"), (37.0, "37"), (1.234e-05, "1.234e-05")])
def test_figures_are_written_to_be_read(spark, value, text):
    assert spark.createDataFrame([(value,)], "v double").select(reconcile.readable("v").alias("t")).collect()[0].t == text


def test_issuance_caveat(spark):
    seen = _ledger(spark, [(ZERO, "a", 5), ("a", "b", 2)])
    unseen = _ledger(spark, [("x", "a", 3), ("x", "b", 1)])
    caveat = lambda t: ledger.issuance_caveat(ledger.issuance_profile(t)).collect()[0].caveat
    assert caveat(seen) is None and "75.0%" in caveat(unseen) and "upper bounds" in caveat(unseen)


def test_balances_are_intervals_and_equal_a_replay(spark):
    import random

    rng = random.Random(9)
    moves = [(rng.choice([ZERO, "a", "b", "c"]), rng.choice([DEAD, "a", "b", "C"]), rng.randint(1, 30)) for _ in range(26)]
    t = _ledger(spark, moves)
    for days in ([3, 4, 11, 27], [1], [28]):
        instants = spark.createDataFrame([(at(d),) for d in days], "as_of timestamp")
        want = {}
        for d in days:
            held = {}
            for k, (f, to, x) in enumerate(moves):
                if 1 + k < d:
                    held[f.lower()] = held.get(f.lower(), 0) - x
                    held[to.lower()] = held.get(to.lower(), 0) + x
            want |= {(d, who): x for who, x in held.items() if x > 0 and who not in (ZERO, DEAD)}
        assert {(r.as_of.day, r.address): r.balance for r in ledger.balances_at(t, instants).collect()} == want
    still = _ledger(spark, [(ZERO, "a", 5), (ZERO, "b", 2), ("b", "c", 2)])
    months = windows.months(spark, "2026-06", "2030-12").select(F.col("end").alias("as_of"), "month")
    assert ledger.balance_intervals(still, months).count() == 2 and ledger.balances_at(still, months).count() == 2 * 55
    plan = ledger.balances_at(still, months)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Cross") + plan.count("Join Inner") == 2  # the list's first and last, twice; no addresses by instants
    assert {r.as_of.month: r.total_supply for r in ledger.supply_at(still, months.limit(3)).collect()} == {7: 7, 8: 7, 9: 7}
    assert ledger.balances_at(still, months.limit(0)).count() == 0 and ledger.supply_at(still, months.limit(0)).count() == 0


def test_balances_at_the_head_need_no_instants(spark):
    t = _ledger(spark, [(ZERO, "a", 500), ("a", "b", 150), ("b", ZERO, 50), ("x", "b", 1)])
    got = lambda *a: {(r.address, r.balance, r.as_of.day) for r in ledger.balances_at_head(t, *a, block="seq").collect()}
    assert got(1) == {("a", 350, 2), ("b", 150, 2)} and got() == {("a", 350, 4), ("b", 101, 4)} and got(-1) == set()
