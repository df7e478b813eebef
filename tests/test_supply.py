"""Supplies replayed in lots whose effects are composed, against a plain replay."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import ledger, steps
from ledgerscope.schemas import DEAD, ZERO


def plain(deltas, start=0):
    out, supply = [], start
    for d in deltas:
        supply += d if d >= 0 or -d <= supply else 0
        out.append(supply)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_a_function_of_moves_is_their_replay_for_every_start(seed):
    rng = random.Random(seed)
    deltas = [rng.choice([rng.randint(0, 9), -rng.randint(0, 25)]) for _ in range(40)]
    at, add = steps.of_moves([float(d) for d in deltas], 3.0, 60.0, 10_000)
    exact = steps.of_moves([Decimal(d) for d in deltas], Decimal(3), Decimal(60), 10_000)
    assert [list(map(int, x)) for x in exact] == [list(map(int, at)), list(map(int, add))] and at == sorted(at)
    halves = [(60.0, *steps.of_moves([float(d) for d in deltas[:17]], 3.0, 60.0, 10_000)), (500.0, *steps.of_moves([float(d) for d in deltas[17:]], 0.0, 500.0, 10_000))]
    for start in range(3, 61):
        want = plain(deltas, start)[-1]
        assert steps.starts(start, [(at, add), ([0], [0])])[1] == want
        assert steps.starts(start, [steps.chain(halves, 10_000), ([0], [0])])[1] == want


def test_too_many_steps_are_given_up():
    folding = [-float(2**k) for k in range(9, -1, -1)]
    assert steps.of_moves(folding, 0.0, 1023.0, 100) == ([], []) and len(steps.of_moves(folding, 0.0, 1023.0, 1024)[0]) == 1024


def ledger_of(spark, cases, kind="double"):
    rows = [(u, i // 4, i, ZERO if d >= 0 else "a", DEAD if d < 0 else "b", None if kind != "double" else float(abs(d)), str(abs(d))) for u, ds in cases.items() for i, d in enumerate(ds)]
    df = spark.createDataFrame(rows, "asset_uid string, bucket int, seq int, from_address string, to_address string, amount double, written string")
    return df.withColumn("amount", F.col("written").cast(kind)).drop("written")


def refused(deltas):
    after = plain(deltas)
    return [d < 0 and -d > b for d, b in zip(deltas, [0, *after[:-1]], strict=True)]


def flags(df):
    out = {}
    for r in df.orderBy("seq").collect():
        out.setdefault(r.asset_uid, []).append(r.dropped)
    return out


def adverse(lots):
    """Each lot's start hangs on whether a burn of the lot before was granted."""
    return [-7] + [x for k in range(lots) for x in (10, -(9 + k % 5), 3, -(4 + k % 3))][:-1]


@pytest.mark.parametrize(("fan", "pieces"), [(4, 1024), (64, 1024), (4, 1)])
def test_rounds_grow_with_the_logarithm_of_the_lots(spark, monkeypatch, fan, pieces):
    written = []
    settled = ledger.settled
    monkeypatch.setattr(ledger, "settled", lambda rows: written.append(1) or settled(rows))
    cases = {"eth:0x1": adverse(64), "eth:0x2": adverse(3), "eth:0x3": [5, -9, 2, -7], "eth:0x4": [5, -2, 3]}
    got = flags(ledger.drop_implausible(ledger_of(spark, cases), lot_rows=4, fan=fan, pieces=pieces))
    assert got == {u: refused(ds) for u, ds in cases.items()}
    # moves, assets, supplies, buckets, lots, lots given up; then one a level. Lots given up take rounds of their own
    if pieces > 1:
        assert len(written) <= 6 + {4: 4, 64: 2}[fan]


def test_amounts_of_38_digits_are_exact(spark):
    big = 10**37
    deltas = [-1, big + 1, -(big + 2), big, 1, -(2 * big + 2), -(2 * big + 1), -1, big + 7, -(big + 7)]
    assert flags(ledger.drop_implausible(ledger_of(spark, {"eth:0x1": deltas}, "decimal(38,0)"), lot_rows=2))["eth:0x1"] == refused(deltas)


def test_rows_between_moves_see_the_last_supply_of_an_earlier_bucket(spark):
    rows = [("a", 0, 0, "x", "y", 1.0, 9), ("a", 0, 1, ZERO, "y", 5.0, 9), ("a", 1, 2, "x", "y", 5.0, 9), ("a", 2, 3, "x", "y", 6.0, 9), ("a", 2, 4, "y", DEAD, 5.0, 9), ("a", 3, 5, "x", "y", 1.0, 9), ("a", 3, 5, "x", "y", 0.0, 9)]
    df = spark.createDataFrame(rows, "asset_uid string, bucket int, seq int, from_address string, to_address string, amount double, extra int")
    got = ledger.drop_implausible(df)
    assert got.columns == [*df.columns, "dropped"]
    assert sorted((r.seq, r.amount, r.dropped) for r in got.collect()) == [(0, 1.0, True), (1, 5.0, False), (2, 5.0, False), (3, 6.0, True), (4, 5.0, False), (5, 0.0, False), (5, 1.0, True)]
    assert ledger.drop_implausible(df.limit(0)).count() == 0


def test_a_long_bucket_is_cut_into_lots(spark):
    moves = spark.createDataFrame([("u", 0, i, float(-3 if i % 3 else 5)) for i in range(100)], "asset_uid string, bucket int, seq int, delta double")
    placed, _ = ledger._lots(moves, 10)
    assert max(r["count"] for r in placed.groupBy("lot").count().collect()) < 20
    got = [r["after"] for r in ledger.supply_after(moves, 10).orderBy("seq").collect()]
    assert got == plain([-3 if i % 3 else 5 for i in range(100)])
