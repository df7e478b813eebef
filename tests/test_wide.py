"""Numbers of 256 bits against Python's integers."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerscope.functions import wide
from ledgerscope.operators import ledger
from ledgerscope.schemas import DEAD, ZERO

UID = "eth:0x1"


def number(text):
    return None if text is None else int(text, 16)


def test_sums_carry_over_all_limbs_and_below_zero(spark):
    rng = random.Random(4)
    rows = [(k % 9, rng.choice([rng.getrandbits(256), rng.getrandbits(70), 2**256 - 1, 2**64 - 1, 2**128, 0]), rng.choice([1, -1])) for k in range(400)]
    df = spark.createDataFrame([(k, f"0x{n:064x}" if n % 3 else hex(n), s) for k, n, s in rows], "k int, data string, sign int").withColumn("n", wide.from_hex(F.col("data")))
    df = df.withColumn("n", F.when(F.col("sign") > 0, F.col("n")).otherwise(wide.minus(df, "n")))
    sums = df.groupBy("k").agg(wide.total(df, "n").alias("s"))
    got = {r.k: r for r in sums.select("k", wide.to_hex(F.col("s")).alias("t"), wide.to_double(F.col("s")).alias("d"), (F.col("s") > wide.zero()).alias("above"), F.col("s.l3").alias("top")).collect()}
    for k in range(9):
        want = sum(n * s for j, n, s in rows if j == k)
        assert number(got[k].t) == (want if abs(want) < 2**256 else None)
        assert got[k].above == (want > 0) and abs(got[k].d - want) <= abs(want) * 1e-12


def test_words_and_decimals(spark):
    words = ["0x", "0x0", "0xff", f"0x{2**256 - 1:x}", "0x1" + "0" * 64, "0xzz", None, "0x" + "0" * 70 + "7"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(wide.to_hex(wide.from_hex(F.col("w"))).alias("t")).collect()
    assert [number(r.t) for r in got] == [0, 0, 255, 2**256 - 1, None, None, None, 7]
    whole = [-(10**38 - 1), -1, 0, 10**38 - 1, -(2**64), 2**64, None]
    df = spark.createDataFrame([(None if n is None else str(n),) for n in whole], "s string").select(wide.to_hex(wide.from_decimal(F.col("s").cast("decimal(38,0)"))).alias("t"))
    assert [number(r.t) for r in df.collect()] == whole


def test_balances_supply_and_reconciliation_beyond_decimals(spark):
    rng = random.Random(6)
    word = lambda n: f"0x{n:064x}"
    who = {0: ZERO, int(DEAD, 16): DEAD, **{k: f"0x{k:040x}" for k in (10, 11, 12)}}
    moves = [(0, 10, 2**250), (0, 11, 2**200 + 5), *((rng.choice([10, 11]), rng.choice([11, 12, int(DEAD, 16)]), rng.getrandbits(190)) for _ in range(30))]
    raw = spark.createDataFrame(
        [(UID, [ledger.TRANSFER_TOPIC, word(f), word(t)], word(n), hex(k), "0x0", f"0x{k}", hex(1_780_000_000 + 86400 * k)) for k, (f, t, n) in enumerate(moves, 1)],
        "asset_uid string, topics array<string>, data string, blockNumber string, logIndex string, transactionHash string, blockTimestamp string",
    )
    t = ledger.decode_logs(raw, whole_words=True).withColumnRenamed("raw", "amount")
    held = {}
    for f, to, n in moves:
        held[who[f]] = held.get(who[f], 0) - n
        held[who[to]] = held.get(who[to], 0) + n  # after the sender's, as some send to themselves
    want = {a: n for a, n in held.items() if n > 0 and a not in (ZERO, DEAD)}
    supply = sum(n for f, _, n in moves if f == 0) - sum(n for f, to, n in moves if f and to == int(DEAD, 16))
    read = lambda rows, c: {r[0]: number(r[1]) for r in rows.select("address" if "address" in rows.columns else "asset_uid", wide.to_hex(F.col(c))).collect()}
    later = spark.createDataFrame([(dt.datetime(2030, 1, 1, tzinfo=dt.timezone.utc),)], "as_of timestamp")
    assert read(ledger.balances_at_head(t), "balance") == want == read(ledger.balances_at(t, later), "balance")
    assert read(ledger.supply_at(t, later), "total_supply") == {UID: supply}
    assert min(n for a, n in held.items() if a not in (ZERO, DEAD)) >= 0 and supply == sum(want.values()) > 2**249
    for off, answer in ((0, True), (1, False)):
        reported = spark.createDataFrame([(UID, hex(supply + off))], "asset_uid string, s string").select("asset_uid", wide.from_hex(F.col("s")).alias("total_supply"))
        assert ledger.reconcile_ledger(t, reported).collect()[0].reconciled is answer
    none = reported.withColumn("total_supply", F.when(F.lit(False), F.col("total_supply")))
    assert ledger.reconcile_ledger(t, none).collect()[0].reconciled is None
