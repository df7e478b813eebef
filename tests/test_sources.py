"""Validation, keys, payloads, the response store and sinks on literals."""

import datetime as dt
import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ledgerscope.functions import keys
from ledgerscope.operators import ledger, status, validate
from ledgerscope.schemas import HOLDERS, SNAPSHOTS, TRANSFERS
from ledgerscope.sources import payloads, store, tables

NOW = dt.datetime(2026, 6, 1, tzinfo=dt.timezone.utc)
GOOD = ("eth:0xa", "node", NOW, NOW, "0xb", 1.0, None)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "asset_uid string, source string, retrieved_at timestamp, as_of timestamp, address string, balance double, balance_usd double")


def test_valid_frame_passes(spark):
    assert validate.validate(frame(spark, GOOD), HOLDERS, "here").count() == 1
    assert validate.empty(spark, HOLDERS).schema == HOLDERS.schema


def test_all_violations_at_once(spark):
    bad = frame(spark, GOOD, GOOD, ("no uid", "", NOW, NOW, "", -1.0, None))
    with pytest.raises(validate.InvalidFrame) as e:
        validate.validate(bad, HOLDERS, "here")
    for part in ("asset_uid: pattern", "source: length", "address: length", "balance: not negative", "unique (2 rows"):
        assert part in str(e.value)


def test_failed_checks_are_counted_in_tasks_without_ranking_rows(spark):
    rows = [("eth:0xa", "node", NOW, NOW, f"0x{i:03d}", None if i % 4 == 0 else -float(i), None) for i in range(200)]
    found = validate.violations(frame(spark, *rows, rows[7]).repartition(5), HOLDERS)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["column"], r["check"]): (r["rows"], r["examples"]) for r in found.collect()}
    assert got[("balance", "null")] == (50, ["null"] * 3) and got[("balance", "not negative")] == (151, ["-1.0", "-10.0", "-101.0"])
    assert got[("asset_uid, source, as_of, address", "unique")][0] == 2 and len(got) == 3
    none = validate.violations(frame(spark, GOOD), HOLDERS)
    assert none.columns == ["column", "check", "rows", "examples"] and none.isEmpty()


def test_shape_problems(spark):
    df = frame(spark, GOOD).drop("address").withColumn("extra", F.lit(1)).withColumn("as_of", F.col("as_of").cast("timestamp_ntz"))
    assert validate.shape_problems(df, HOLDERS) == ["address: missing", "extra: unexpected", "as_of: timestamps must carry a zone"]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


def test_addresses_and_times(spark):
    assert one(spark, keys.canonical_address(F.lit(" 0x" + "A" * 40))) == "0x" + "a" * 40
    assert one(spark, keys.canonical_address(F.lit("StellarKey"))) == "StellarKey"
    assert one(spark, keys.canonical_address(F.lit("a:b"))) is None
    assert one(spark, keys.parse_uid(F.lit("a:b:c"))) is None
    for raw in ("2026-06-01 00:00:00 UTC", "2026-06-01T00:00:00.000Z", "2026-06-01 02:00:00+02:00"):
        assert one(spark, keys.parse_utc(F.lit(raw))).replace(tzinfo=dt.timezone.utc) == NOW
    assert one(spark, keys.parse_utc(F.lit("soon"))) is None


@pytest.mark.parametrize("n", [0, 1, 2**63, 2**64, 10**37, 2**126 - 1])
def test_hex_numbers(spark, n):
    assert int(one(spark, keys.hex_to_decimal(F.lit(f"0x{n:064x}")))) == n


def test_hex_overflow_is_null(spark):
    assert one(spark, keys.hex_to_decimal(F.lit(f"0x{2**126:064x}"))) is None


def test_contract_text(spark):
    text = "Tether  Gold\x00"
    raw = text.encode().hex()
    dynamic = f"0x{32:064x}{len(text):064x}" + raw.ljust(64, "0")
    assert one(spark, keys.contract_text(F.lit(dynamic))) == "Tether Gold"
    assert one(spark, keys.contract_text(F.lit("0x" + b"MKR".hex().ljust(64, "0")))) == "MKR"


def test_digest_does_not_depend_on_order(spark):
    a = keys.request_digest(F.lit("s"), F.lit("d"), F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), F.lit("2")))
    b = keys.request_digest(F.lit("s"), F.lit("d"), F.create_map(F.lit("y"), F.lit("2"), F.lit("x"), F.lit("1")))
    assert one(spark, a) == one(spark, b) and len(one(spark, a)) == 16


def test_saved_query_contract(spark):
    row = {"block_time": "2026-06-01 00:00:00.000 UTC", "tx_hash": "0x1", "log_index": "0", "contract_address": "0xA", "from_address": "0xB", "to_address": "0xC", "amount": "2"}
    page = lambda rows, state="QUERY_STATE_COMPLETED": spark.createDataFrame([(json.dumps({"state": state, "result": {"rows": rows}}),)], "body string")
    r = payloads.saved_query_transfers(page([row]), "Ethereum").collect()[0]
    assert (r.asset_uid, r.from_address, r.amount, r.amount_usd) == ("ethereum:0xA", "0xb", 2.0, None)
    with pytest.raises(payloads.ContractError, match="amount"):
        payloads.saved_query_transfers(page([{k: v for k, v in row.items() if k != "amount"}]), "e")
    with pytest.raises(payloads.ContractError, match="unfinished"):
        payloads.saved_query_transfers(page([row], "QUERY_STATE_EXECUTING"), "e")
    with pytest.raises(payloads.ContractError, match="no format"):
        payloads.saved_query_transfers(page([row | {"block_time": "soon"}]), "e")


def test_price_series_and_list_payloads(spark):
    want = spark.createDataFrame([("e:0xa",), ("e:0xb",)], "asset_uid string")
    body = json.dumps({"coins": {"e:0xa": {"price": 2.0, "symbol": "A", "decimals": 6, "timestamp": 1780272000}}})
    found, absent = payloads.prices(spark.createDataFrame([(body,)], "body string"), want)
    assert found.collect()[0].price_usd == 2.0 and absent.collect()[0].asset_uid == "e:0xb"
    tvl = json.dumps({"chainTvls": {"Ethereum": {"tvl": [{"date": 1, "totalLiquidityUSD": 5.0}, {"date": 2, "totalLiquidityUSD": 7.0}]}}})
    assets = spark.createDataFrame([("e:0xa", "x", "Ethereum"), ("e:0xb", "x", "Base")], "asset_uid string, slug string, chain string")
    found, rejected = payloads.protocol_series(spark.createDataFrame([("x", tvl)], "slug string, body string"), assets)
    assert found.collect()[0].market_value_usd == 7.0 and [r.asset_uid for r in rejected.collect()] == ["e:0xb"]
    listed = json.dumps({"results": [{"network": " Big  Chain", "address": "0xa", "symbol": "A", "price": {"val": 1.5}}, {"network": "big chain", "address": "0xa", "symbol": "B"}]})
    found, absent = payloads.token_list(spark.createDataFrame([(1, listed)], "page int, body string"), spark.createDataFrame([("bc:0xa",), ("bc:0xz",)], "asset_uid string"), {"big-chain": "bc"})
    assert found.collect()[0].symbol == "A" and absent.count() == 1


def test_contract_snapshots(spark):
    calls = [("e:0xa", payloads.SELECTORS["decimals"], 5, f"0x{6:064x}"), ("e:0xa", payloads.SELECTORS["totalSupply"], 5, f"0x{2_500_000:064x}"), ("e:0xb", payloads.SELECTORS["totalSupply"], 5, f"0x{1:064x}")]
    got = {r.asset_uid: r for r in payloads.contract_snapshots(spark.createDataFrame(calls, "asset_uid string, selector string, block long, result string")).collect()}
    assert got["e:0xa"].total_supply == 2.5 and got["e:0xb"].error_code == "no_decimals"


def test_store_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s", "d", {"k": "1"}, NOW, "old"), ("s", "d", {"k": "1"}, NOW + dt.timedelta(days=1), "new"), ("t", "d", {"k": "2"}, NOW, '{"error": 1}')], "source string, dataset string, params map<string,string>, retrieved_at timestamp, body string")
    path = str(tmp_path / "store")
    store.put(rows, path)
    held = spark.read.parquet(path)
    assert sorted(r.body for r in store.get(held).collect()) == ["new", '{"error": 1}']
    assert [r.body for r in store.without_faults(store.get(held)).collect()] == ["new"]
    later = F.lit(NOW + dt.timedelta(days=2))
    assert [r.body for r in store.get(held, 86_400, later).collect()] == ["new"]
    store.clear(spark, path, "t")
    assert spark.read.parquet(path).select("source").distinct().collect()[0].source == "s"
    held = store.read(spark, path, rows.schema)
    assert store.get(held).count() == 1
    tables.write(held.select("source"), str(tmp_path / "a" / "x.csv"))
    tables.write(held.select("body"), str(tmp_path / "b" / "x.parquet"))
    assert spark.read.parquet(str(tmp_path / "b" / "x.parquet")).count() == 2
    store.clear(spark, path)
    assert store.get(store.read(spark, path, rows.schema)).count() == 0
    store.put(rows, path)
    assert store.read(spark, path, rows.schema).count() == 3
    with pytest.raises(ValueError, match="zone"):
        store.put(rows.withColumn("retrieved_at", F.lit("2026-06-01").cast("timestamp_ntz")), path)
    with pytest.raises(ValueError, match="unknown format"):
        tables.write(held, str(tmp_path / "x.xlsx"))


def test_csv_is_read_by_name(spark, tmp_path):
    (tmp_path / "holder_balances.csv").write_text("balance,address,as_of,retrieved_at,source,asset_uid,balance_usd\n1.5,0xb,2026-06-01T02:00:00+02:00,2026-06-01T00:00:00+00:00,node,e:0xa,\n")
    r = tables.read_csv(spark, str(tmp_path / "holder_balances.csv"), HOLDERS).collect()[0]
    assert r.balance == 1.5 and r.as_of.replace(tzinfo=dt.timezone.utc) == NOW and r.balance_usd is None


def test_missing_kinds(spark):
    f = spark.createDataFrame([("a", "x", "transfers", True), ("a", "y", "holders", False), ("b", "x", "transfers", False)], "asset_uid string, source string, kind string, ok boolean")
    got = {r.asset_uid: r.missing_kinds for r in status.missing_kinds(f, f.select("asset_uid").distinct()).collect()}
    assert got == {"a": ["holders"], "b": ["holders", "transfers"]}


def test_payload_jobs_give_valid_tables(spark):
    now, none = F.lit(NOW), spark.createDataFrame([], "asset_uid string, address string")
    row = {"block_time": "2026-06-01 00:00:00.000 UTC", "tx_hash": "0x1", "log_index": "0", "contract_address": "0xA", "from_address": "0xB", "to_address": "0xC", "amount": "2"}
    pages = lambda rows: spark.createDataFrame([(json.dumps({"state": "QUERY_STATE_COMPLETED", "result": {"rows": rows}}),)], "body string")
    want = spark.createDataFrame([("e:0xA",)], "asset_uid string")
    t = payloads.saved_query_transfers(pages([row, row | {"tx_hash": "0x2", "contract_address": "0xZ"}, row | {"tx_hash": "0x3", "block_time": "2026-07-01 00:00:00"}]), "E")
    t = payloads.scoped(t, want, F.lit(NOW), F.lit(NOW + dt.timedelta(days=30)))
    got = validate.validate(payloads.completed(t, TRANSFERS, "query", now, issuers=none), TRANSFERS, "transfers").collect()
    assert [(r.tx_hash, r.kind, r.source) for r in got] == [("0x1", "secondary", "query")]
    h = payloads.saved_query_holders(pages([{"contract_address": "0xA", "address": "0xB", "balance": "2"}]), "E", now)
    assert validate.validate(payloads.completed(payloads.scoped(h, want), HOLDERS, "query", now), HOLDERS, "holders").count() == 1
    body = json.dumps({"coins": {"e:0xA": {"price": 2.0, "symbol": "A", "decimals": 6, "timestamp": 1780272000}}})
    price, _ = payloads.prices(spark.createDataFrame([(body,)], "body string"), want)
    tvl = json.dumps({"chainTvls": {"E": {"tvl": [{"date": 2, "totalLiquidityUSD": 7.0}]}}})
    series, _ = payloads.protocol_series(spark.createDataFrame([("x", tvl)], "slug string, body string"), spark.createDataFrame([("e:0xA", "x", "E")], "asset_uid string, slug string, chain string"))
    listed, _ = payloads.token_list(spark.createDataFrame([(1, json.dumps({"results": [{"network": "e", "address": "0xA", "symbol": "A"}]}))], "page int, body string"), want, {})
    calls = payloads.contract_snapshots(spark.createDataFrame([("e:0xA", payloads.SELECTORS["decimals"], 5, f"0x{6:064x}")], "asset_uid string, selector string, block long, result string"))
    for name, rows in (("prices", price), ("series", series), ("list", listed), ("calls", calls)):
        got = validate.validate(payloads.completed(rows, SNAPSHOTS, name, now), SNAPSHOTS, name).collect()
        assert len(got) == 1 and got[0].source == name and got[0].as_of is not None


def test_dimensions_are_checked(spark):
    assets = spark.createDataFrame([("e:0xa", "A"), ("e:0xb", "B")], "asset_uid string, symbol string")
    assert tables.asset_dimension(assets).count() == 2
    with pytest.raises(validate.InvalidFrame, match="twice"):
        tables.asset_dimension(assets.union(assets))
    with pytest.raises(validate.InvalidFrame, match="field"):
        tables.asset_dimension(spark.createDataFrame([("e:0xa", "")], assets.schema))
    known = spark.createDataFrame([("e:0xa", "issuer", "0xAB", "by hand")], "asset_uid string, role string, address string, note string")
    assert tables.address_dimension(known).collect()[0].address == "0xab"
    with pytest.raises(validate.InvalidFrame, match="note"):
        tables.address_dimension(known.withColumn("note", F.lit(" ")))


def test_one_asset_only(spark):
    status.assert_one_asset(spark.createDataFrame([("a",), ("a",)], "asset_uid string"))
    with pytest.raises(ValueError, match="more than one"):
        status.assert_one_asset(spark.createDataFrame([("a",), ("b",)], "asset_uid string"))


def test_malformed_numbers_are_null(spark):
    cases = [("0x1f", 31), ("1F", 31), ("0x" + "0" * 63 + "a", 10), ("0x" + "f" * 15, 16**15 - 1), ("0x1" + "0" * 15, None), ("f" * 20, None), ("0x", None), ("zz", None), ("", None), (None, None)]
    got = spark.createDataFrame([(k, h) for k, (h, _) in enumerate(cases)], "k int, h string").select("k", keys.hex_to_long(F.col("h")).alias("n")).collect()
    assert {r.k: r.n for r in got} == {k: n for k, (_, n) in enumerate(cases)}


def test_decimals_beyond_a_byte_are_missing(spark):
    calls = [(f"e:{k}", payloads.SELECTORS["decimals"], 5, f"0x{n:064x}") for k, n in enumerate([0, 255, 256, 2**200 + 6])]
    got = payloads.contract_snapshots(spark.createDataFrame(calls, "asset_uid string, selector string, block long, result string")).collect()
    assert {r.asset_uid: (r.decimals, r.error_code) for r in got} == {"e:0": (0, None), "e:1": (255, None), "e:2": (None, "no_decimals"), "e:3": (None, "no_decimals")}


def test_skipped_logs_and_unresolved_times_are_counted_in_the_pass_that_decodes(spark):
    def log(block, topics=3, at="0x0", index="0x1"):
        return ("a", block, index, "0xt", [ledger.TRANSFER_TOPIC, "0x" + "0" * 64, "0x" + "1" * 64][:topics], "0x5", at)

    raw = [log("0x1"), log("0x2"), log("0x3", at="0x10"), log("f" * 20), log(None), log("0x1", topics=2), log("0x1", index="0x")]
    schema = "asset_uid string, blockNumber string, logIndex string, transactionHash string, topics array<string>, data string, blockTimestamp string"
    blocks = spark.createDataFrame([(1, dt.datetime(2024, 1, 1))], "number long, timestamp timestamp")
    skipped, unresolved = Observation(), Observation()
    read = spark.sparkContext.accumulator(0)
    rows = ledger.decode_logs(spark.createDataFrame(raw, schema).withColumn("data", F.udf(lambda x: (read.add(1), x)[1])("data")), blocks, skipped, unresolved).collect()
    assert sorted(r.block for r in rows) == [1, 2, 3] and [r.block for r in rows if r.block_time is None] == [2]
    assert (skipped.get, unresolved.get) == ({"skipped_logs": 4}, {"unresolved_times": 1}) and read.value <= len(raw)
    assert ledger.scan_logs(spark.createDataFrame(raw, schema)).count() == 5
