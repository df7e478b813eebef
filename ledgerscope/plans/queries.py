"""The registered queries over the driver's tables, lsNN_<name> for operator NN, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerscope.functions import classify as cl
from ledgerscope.functions import keys, wide
from ledgerscope.operators import asof, ledger, measures, panel, reconcile, report, status, validate, windows
from ledgerscope.plans import fixtures as fx
from ledgerscope.schemas import TRANSFERS, ZERO
from ledgerscope.shared import settled
from ledgerscope.sources import payloads, store
from ledgerscope.streaming.volumes import tumbling_volumes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query; ``sql`` is a SELECT over the common table expressions."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {fx.CTES} {sql}"
        return f

    return add


def _r(*names: str) -> list:
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


def _placed(spark: SparkSession, sf: str, t: DataFrame | None = None) -> DataFrame:
    return windows.assign(fx.classified(spark, sf, t), fx.month_list(spark, sf))


def _universe(spark: SparkSession, sf: str, t: DataFrame | None = None) -> DataFrame:
    return panel.skeleton(fx.transfers(spark, sf) if t is None else t, fx.month_list(spark, sf))


def _scanned(logs: DataFrame) -> DataFrame:
    return logs.groupBy("asset_uid", "block_window").agg(F.count("*").alias("n"), F.max(keys.hex_to_long(F.col("blockNumber"))).alias("last_block"))


def _blocks(spark: SparkSession, sf: str, t: DataFrame | None = None) -> DataFrame:
    return (fx.transfers(spark, sf) if t is None else t).select(F.substring("tx_hash", 3, 20).cast("long").alias("number"), F.col("block_time").alias("timestamp"))


def _held(spark: SparkSession, sf: str, t: DataFrame | None = None) -> DataFrame:
    return asof.exact_state(fx.balances(spark, sf, t), fx.month_list(spark, sf))


# ---- sources


@query("""SELECT asset_uid, bw AS block_window, count(*) AS n, max(l_orderkey) AS last_block FROM (SELECT *, l_orderkey - l_orderkey % 1000 AS bw FROM t WHERE l_orderkey <= 9000) GROUP BY ALL""")
def ls07_log_scan(spark, sf):
    """To the pinned head 9000 of its SQL, whatever the table holds; ls07_log_scan_newest reads on to the newest block."""
    return _scanned(ledger.scan_logs(fx.raw_logs(spark, sf), 9000, 1000))


@query("""SELECT asset_uid, bw AS block_window, count(*) AS n, max(l_orderkey) AS last_block FROM (SELECT *, l_orderkey - l_orderkey % 1000 AS bw FROM t) GROUP BY ALL""")
def ls07_log_scan_newest(spark, sf):
    return _scanned(ledger.scan_logs(fx.raw_logs(spark, sf), step=1000))


@query("""SELECT source, dataset, sum(v) AS v, count(*) AS n FROM (SELECT 'x' AS source, event_type AS dataset, user_id, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY ALL) GROUP BY ALL""")
def ls03_newest_response(spark, sf):
    e = fx.table(spark, sf, "events")
    rows = e.select(
        F.lit("x").alias("source"), F.col("event_type").alias("dataset"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("params"),
        F.struct(F.col("ts").cast("timestamp").alias("t"), "event_id").alias("retrieved_at"), F.col("value").alias("v"),
    )
    return store.get(store.with_digest(rows)).groupBy("source", "dataset").agg(F.sum("v").alias("v"), F.count("*").alias("n"))


@query("""SELECT k, count(*) AS n FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'error') GROUP BY ALL""")
def ls06_fault_filter(spark, sf):
    e = fx.table(spark, sf, "events").withColumn("body", F.when(F.col("event_type") == "error", F.lit('{"error": {"code": 1}}')).otherwise(F.col("props")))
    return store.without_faults(e).select(F.from_json("body", "k bigint")["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("""SELECT asset_uid, count(*) AS n, sum(amount) AS amount, count(amount_usd) AS priced, strftime(max(block_time), '%Y-%m-%d') AS latest FROM t GROUP BY ALL""")
def ls08_saved_query_transfers(spark, sf):
    """Rows pass through a page of JSON each hundred or so and back."""
    t = fx.transfers(spark, sf)
    fields = {
        "block_time": F.date_format("block_time", "yyyy-MM-dd HH:mm:ss.SSS' UTC'"), "tx_hash": F.col("tx_hash"), "log_index": F.col("log_index").cast("string"),
        "contract_address": F.element_at(F.split("asset_uid", ":"), 2), "from_address": F.col("from_address"), "to_address": F.col("to_address"), "amount": F.col("amount").cast("string"),
    }
    row = F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)], F.lit("amount_usd"), F.col("amount_usd").cast("string")), lambda k, v: v.isNotNull())
    # blocks of some 30 orders, so that a page stays as it is however many rows there are
    pages = t.groupBy(F.floor(F.substring("tx_hash", 3, 20).cast("long") / 30).alias("page")).agg(F.collect_list(row).alias("rows"))
    body = F.to_json(F.struct(F.lit("QUERY_STATE_COMPLETED").alias("state"), F.struct("rows").alias("result")))
    got = payloads.saved_query_transfers(pages.select(body.alias("body")), "tpch")
    return got.groupBy("asset_uid").agg(
        F.count("*").alias("n"), F.sum("amount").alias("amount"), F.count("amount_usd").alias("priced"), F.date_format(F.max("block_time"), "yyyy-MM-dd").alias("latest")
    )


@query("""SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS parsed, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 4 GROUP BY ALL
UNION ALL SELECT NULL, count(*) FROM orders WHERE o_orderkey % 5 = 4""")
def ls10_utc_timestamps(spark, sf):
    o, d = fx.table(spark, sf, "orders"), F.col("o_orderdate")
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, F.date_format(d, "yyyy-MM-dd HH:mm:ss' UTC'")).when(k == 1, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).when(k == 2, F.date_format(d, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    raw = raw.when(k == 3, F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))).otherwise("n/a")
    return o.select(F.date_format(keys.parse_utc(raw), "yyyy-MM-dd HH:mm:ss").alias("parsed")).groupBy("parsed").agg(F.count("*").alias("n"))


@query("""SELECT asset_uid, max(balance) AS most, count(*) AS holders, sum(balance) AS held FROM b WHERE window_id = '1998-12' GROUP BY ALL""")
def ls11_saved_query_holders(spark, sf):
    h = _held(spark, sf).filter("window_id = '1998-12'")
    row = F.create_map(F.lit("contract_address"), F.element_at(F.split("asset_uid", ":"), 2), F.lit("address"), F.col("address"), F.lit("balance"), F.col("balance").cast("string"))
    pages = h.groupBy(F.pmod(F.xxhash64("address", "asset_uid"), F.lit(64)).alias("page")).agg(F.collect_list(row).alias("rows"))
    body = F.to_json(F.struct(F.lit("QUERY_STATE_COMPLETED").alias("state"), F.struct("rows").alias("result")))
    got = payloads.saved_query_holders(pages.select(body.alias("body")), "tpch", F.lit("1999-01-01").cast("timestamp"))
    return got.groupBy("asset_uid").agg(F.max("balance").alias("most"), F.count("*").alias("holders"), F.sum("balance").alias("held"))


# ---- keys, validation, union


@query("""SELECT lower(from_address) AS address, count(*) AS n FROM t GROUP BY ALL""")
def ls18_canonical_address(spark, sf):
    return fx.transfers(spark, sf).groupBy(keys.canonical_address(F.col("from_address")).alias("address")).agg(F.count("*").alias("n"))


@query("""SELECT split_part(asset_uid, ':', 1) AS chain, split_part(asset_uid, ':', 2) AS address, count(*) AS n FROM t GROUP BY ALL""")
def ls19_uid_parse(spark, sf):
    return fx.transfers(spark, sf).select(keys.parse_uid(F.col("asset_uid")).alias("p")).groupBy("p.chain", "p.address").agg(F.count("*").alias("n"))


_BROKEN = """(SELECT asset_uid, tx_hash, log_index, CASE WHEN l_orderkey % 11 = 0 THEN '' ELSE to_address END AS to_address,
  CASE WHEN l_orderkey % 13 = 0 THEN NULL WHEN l_orderkey % 17 = 0 THEN 'x' ELSE CAST(CASE WHEN l_orderkey % 19 = 0 THEN -amount ELSE amount END AS VARCHAR) END AS amount,
  CASE WHEN l_orderkey % 23 = 0 THEN 'gift' ELSE 'mint' END AS kind FROM t)"""


@query(
    f"""SELECT 'to_address' AS "column", 'length' AS "check", count(*) AS rows FROM {_BROKEN} WHERE to_address = ''
UNION ALL SELECT 'amount', 'null', count(*) FROM {_BROKEN} WHERE amount IS NULL UNION ALL SELECT 'amount', 'type', count(*) FROM {_BROKEN} WHERE amount = 'x'
UNION ALL SELECT 'amount', 'not negative', count(*) FROM {_BROKEN} WHERE TRY_CAST(amount AS DOUBLE) < 0 UNION ALL SELECT 'kind', 'membership', count(*) FROM {_BROKEN} WHERE kind = 'gift'
UNION ALL SELECT 'asset_uid, source, tx_hash, log_index', 'unique', sum(n) FROM (SELECT count(*) AS n FROM t GROUP BY asset_uid, tx_hash, log_index HAVING count(*) > 1)"""
)
def ls28_violation_report(spark, sf):
    """Covers operators 24 to 28: types, nulls, patterns, ranges, membership and keys in one report."""
    k = F.substring("tx_hash", 3, 20).cast("long")
    bad = fx.transfers(spark, sf).withColumn("to_address", F.when(k % 11 == 0, "").otherwise(F.col("to_address")))
    amount = F.when(k % 19 == 0, -F.col("amount")).otherwise(F.col("amount")).cast("string")
    bad = bad.withColumn("amount", F.when(k % 13 == 0, None).when(k % 17 == 0, "x").otherwise(amount)).withColumn("kind", F.when(k % 23 == 0, "gift").otherwise("mint"))
    bad = bad.withColumn("retrieved_at", F.lit("2000-01-01").cast("timestamp"))
    return validate.violations(bad, TRANSFERS).select("column", "check", "rows")


@query("""SELECT asset_uid, tx_hash, log_index, count(*) AS n FROM t GROUP BY ALL HAVING count(*) > 1""")
def ls27_composite_key(spark, sf):
    return fx.transfers(spark, sf).groupBy("asset_uid", "tx_hash", "log_index").agg(F.count("*").alias("n")).filter("n > 1")


@query("""SELECT asset_uid, source, count(*) AS n FROM (SELECT asset_uid, source FROM s UNION ALL SELECT asset_uid, source FROM t) GROUP BY ALL""")
def ls30_union(spark, sf):
    both = status.union_sources(fx.snapshots(spark, sf).select("asset_uid", "source"), fx.transfers(spark, sf).select("asset_uid", "source"))
    return both.groupBy("asset_uid", "source").agg(F.count("*").alias("n"))


def _fetches(spark, sf):
    o = fx.table(spark, sf, "orders")
    return o.select(fx.uid(F.col("o_custkey")).alias("asset_uid"), F.col("o_orderpriority").alias("source"), F.when(F.col("o_custkey") % 2 == 0, "holders").otherwise("transfers").alias("kind"), ((F.col("o_orderkey") % 25 < 20) & (F.col("o_custkey") % 5 < 3)).alias("ok"))


_FETCH = f"""(SELECT {fx._UID.format("o_custkey")} AS asset_uid, CASE WHEN o_custkey % 2 = 0 THEN 'holders' ELSE 'transfers' END AS kind, (o_orderkey % 25 < 20 AND o_custkey % 5 < 3) AS ok FROM orders)"""


@query(
    f"""SELECT asset_uid, string_agg(kind, ',' ORDER BY kind) AS missing FROM (SELECT a.asset_uid, k.kind FROM (SELECT DISTINCT asset_uid FROM t) a, (SELECT DISTINCT kind FROM {_FETCH}) k
WHERE NOT EXISTS (SELECT 1 FROM {_FETCH} f WHERE f.ok AND f.asset_uid = a.asset_uid AND f.kind = k.kind)) GROUP BY ALL"""
)
def ls31_missing_kinds(spark, sf):
    out = status.missing_kinds(_fetches(spark, sf), fx.transfers(spark, sf).select("asset_uid").distinct())
    return out.select("asset_uid", F.array_join("missing_kinds", ",").alias("missing"))


@query(
    f"""SELECT {fx._UID.format("o_custkey")} AS asset_uid, CAST(sum(o_orderkey % 3) AS BIGINT) AS dropped, arg_max(o_orderstatus, (o_orderpriority, o_orderkey)) = 'F' AS reconciled FROM orders GROUP BY 1"""
)
def ls32_quality_merge(spark, sf):
    o = fx.table(spark, sf, "orders")
    rows = o.select(fx.uid(F.col("o_custkey")).alias("asset_uid"), F.struct("o_orderpriority", "o_orderkey").alias("source_order"), (F.col("o_orderkey") % 3).alias("dropped"), (F.col("o_orderstatus") == "F").alias("reconciled"))
    return status.merge_quality(rows)


@query("""SELECT asset_uid, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT DISTINCT asset_uid, source FROM (SELECT asset_uid, source FROM s UNION ALL SELECT asset_uid, source FROM t)) GROUP BY ALL""")
def ls33_contributing_sources(spark, sf):
    out = status.contributing_sources(fx.snapshots(spark, sf), fx.transfers(spark, sf))
    return out.select("asset_uid", F.array_join("sources", ",").alias("sources"))


# ---- filters and windows


@query("""SELECT asset_uid, count(*) AS n, sum(amount) AS amount FROM t WHERE block_time >= TIMESTAMP '1997-03-01' AND block_time < TIMESTAMP '1997-06-01' GROUP BY ALL""")
def ls35_window_clip(spark, sf):
    """With 34: the asset is the group key."""
    t = fx.transfers(spark, sf).filter((F.col("block_time") >= F.lit("1997-03-01").cast("timestamp")) & (F.col("block_time") < F.lit("1997-06-01").cast("timestamp")))
    return t.groupBy("asset_uid").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query("""SELECT asset_uid, 'all' AS mode, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT asset_uid, 'secondary_only', count(*) FROM k WHERE kind = 'secondary' GROUP BY ALL
UNION ALL SELECT asset_uid, 'primary_only', count(*) FROM k WHERE kind IN ('mint', 'burn') GROUP BY ALL""")
def ls36_modes(spark, sf):
    return fx.classified(spark, sf).withColumn("mode", F.explode(measures._modes())).groupBy("asset_uid", "mode").agg(F.count("*").alias("n"))


@query("""SELECT b.asset_uid, b.window_id, count(*) FILTER (x.address IS NULL) AS retained, count(x.address) AS excluded FROM b LEFT JOIN exc x ON b.asset_uid = x.asset_uid AND b.address = x.address GROUP BY ALL""")
def ls38_holder_exclusion(spark, sf):
    h = measures.prepare_holders(_held(spark, sf), fx.lists(spark)[1])
    return h.groupBy("asset_uid", "window_id").agg(F.count_if("retained").alias("retained"), F.count_if(~F.col("retained")).alias("excluded"))


@query("""SELECT asset_uid, window_id, count(*) AS n FROM p WHERE category = 'residual' AND amount > 0 AND lower(from_address) <> lower(to_address) GROUP BY ALL""")
def ls39_participation_predicate(spark, sf):
    """With 37: membership by lower-cased address."""
    return _placed(spark, sf).filter(cl.participates()).groupBy("asset_uid", "window_id").agg(F.count("*").alias("n"))


@query("""SELECT strftime(e, '%Y-%m-%d') AS window_id, count(t.block_time) AS n FROM (SELECT TIMESTAMP '1999-01-01' - i * INTERVAL 30 DAY AS e FROM range(12) r(i)) LEFT JOIN t ON block_time >= e - INTERVAL 30 DAY AND block_time < e GROUP BY ALL""")
def ls40_trailing_windows(spark, sf):
    w = windows.windows_ending(spark, "1999-01-01", 30, 12)
    n = windows.assign(fx.transfers(spark, sf), w).groupBy("window_id").agg(F.count("*").alias("n"))
    return w.select("window_id").join(n, "window_id", "left").fillna(0, ["n"])


@query("""SELECT w.window_id, date_diff('day', start, "end") AS days, count(p.asset_uid) AS n FROM w LEFT JOIN p ON p.window_id = w.window_id GROUP BY ALL""")
def ls41_calendar_months(spark, sf):
    w = fx.month_list(spark, sf)
    n = windows.assign_month(fx.transfers(spark, sf)).groupBy("window_id").agg(F.count("*").alias("n"))
    return w.join(n, "window_id", "left").select("window_id", F.datediff("end", "start").cast("long").alias("days"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT asset_uid, window_id, count(*) AS n FROM p GROUP BY ALL""")
def ls42_assign_windows(spark, sf):
    return windows.assign(fx.transfers(spark, sf), fx.month_list(spark, sf)).groupBy("asset_uid", "window_id").agg(F.count("*").alias("n"))


@query("""SELECT w.window_id, min(l_orderkey) AS first_block, max(l_orderkey) AS last_block FROM w LEFT JOIN t ON block_time >= start AND block_time < "end" AND l_orderkey <= 9000 GROUP BY ALL""")
def ls43_block_ranges(spark, sf):
    """To the pinned head 9000 of its SQL; ls43_block_ranges_newest reads on to the newest block."""
    return windows.block_ranges(_blocks(spark, sf), fx.month_list(spark, sf), 9000)


@query("""SELECT w.window_id, min(l_orderkey) AS first_block, max(l_orderkey) AS last_block FROM w LEFT JOIN t ON block_time >= start AND block_time < "end" GROUP BY ALL""")
def ls43_block_ranges_newest(spark, sf):
    return windows.block_ranges(_blocks(spark, sf), fx.month_list(spark, sf))


# ---- ledger


@query("""SELECT asset_uid, lower(from_address) AS from_address, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount, strftime(max(CASE WHEN (l_orderkey * 8 + l_linenumber) % 5 <> 0 THEN block_time END), '%Y-%m-%d') AS latest
FROM t WHERE (l_orderkey * 8 + l_linenumber) % 7 <> 0 GROUP BY ALL""")
def ls45_log_decode(spark, sf):
    d = ledger.decode_logs(fx.raw_logs(spark, sf))
    return d.groupBy("asset_uid", "from_address").agg(F.count("*").alias("n"), F.sum("raw").cast("double").alias("amount"), F.date_format(F.max("block_time"), "yyyy-MM-dd").alias("latest"))


@query("""SELECT asset_uid, lower(from_address) AS from_address, '0x' || lower(to_hex(CAST(sum(amount) AS BIGINT))) || repeat('0', 40) AS whole, CAST(sum(amount) AS DOUBLE) AS amount
FROM t WHERE (l_orderkey * 8 + l_linenumber) % 7 <> 0 GROUP BY ALL""")
def ls45_wide_amounts(spark, sf):
    """Amounts of 256 bits, each the ledger's own times 2^160, added up exactly."""
    logs = fx.raw_logs(spark, sf).withColumn("data", F.concat(F.lit("0x"), F.right("data", F.lit(24)), F.lit("0" * 40)))
    d = ledger.decode_logs(logs, whole_words=True)
    sums = d.groupBy("asset_uid", "from_address").agg(wide.total(d, "raw").alias("raw"))
    return sums.select("asset_uid", "from_address", wide.to_hex(F.col("raw")).alias("whole"), (wide.to_double(F.col("raw")) / F.lit(2.0**160)).alias("amount"))


#: The ledger replayed row by row: the supply after each row and whether it is dropped.
_REPLAYED = """(WITH RECURSIVE o AS MATERIALIZED (SELECT asset_uid, CAST(seq AS BIGINT) AS seq, amount, fb, tb FROM k), r AS (SELECT asset_uid, CAST(0 AS BIGINT) AS seq, CAST(0 AS DOUBLE) AS supply, false AS dropped FROM o WHERE seq = 1
UNION ALL SELECT o.asset_uid, o.seq, CASE WHEN o.fb THEN supply + o.amount WHEN o.amount > supply OR NOT o.tb THEN supply ELSE supply - o.amount END, NOT o.fb AND o.amount > supply FROM r JOIN o ON o.asset_uid = r.asset_uid AND o.seq = r.seq + 1)
SELECT * FROM r WHERE seq > 0)"""


def _ordered(spark, sf):
    """What a replay reads of the transfers, joined and ordered once."""
    return settled(fx.transfers(spark, sf, False).select("asset_uid", "from_address", "to_address", "amount", "bucket", "seq"))


@query(f"""SELECT t.asset_uid, window_id || '/' || lpad(CAST(t.seq - min(t.seq) OVER (PARTITION BY t.asset_uid, window_id) + 1 AS VARCHAR), 12, '0') AS seq, t.amount, r.dropped FROM t JOIN {_REPLAYED} r ON r.asset_uid = t.asset_uid AND r.seq = t.seq""")
def ls46_implausible(spark, sf):
    return ledger.drop_implausible(_ordered(spark, sf)).select("asset_uid", "seq", "amount", "dropped")


@query(f"SELECT asset_uid, count(*) FILTER (dropped) AS dropped FROM {_REPLAYED} GROUP BY ALL")
def ls47_dropped_counts(spark, sf):
    t = _ordered(spark, sf)
    return ledger.dropped_counts(ledger.drop_implausible(t), t.select("asset_uid").distinct())


@query("""SELECT l_orderkey AS block, strftime(max(m), '%Y-%m-%d') AS latest, count(*) AS n FROM (SELECT *, max(block_time) OVER (PARTITION BY l_orderkey) AS m FROM t) WHERE (l_orderkey * 8 + l_linenumber) % 7 <> 0 GROUP BY ALL""")
def ls48_block_times(spark, sf):
    logs = fx.raw_logs(spark, sf)
    t = fx.transfers(spark, sf).select(F.substring("tx_hash", 3, 20).cast("long").alias("number"), "block_time")
    decoded = ledger.decode_logs(logs.withColumn("blockTimestamp", F.lit("0x0")), t.groupBy("number").agg(F.max("block_time").alias("timestamp")))
    return decoded.groupBy("block").agg(F.date_format(F.max("block_time"), "yyyy-MM-dd").alias("latest"), F.count("*").alias("n"))


@query("""SELECT asset_uid, round(sum(amount) / 1000000, 6) AS amount FROM t GROUP BY ALL""")
def ls49_human_scaling(spark, sf):
    s = fx.transfers(spark, sf).groupBy("asset_uid").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("raw")).withColumn("decimals", F.lit(6))
    return s.select("asset_uid", F.round(ledger.human("raw", "decimals"), 6).alias("amount"))


@query("""SELECT asset_uid, window_id, address, balance FROM b""")
def ls50_balances(spark, sf):
    return _held(spark, sf).select("asset_uid", "window_id", "address", "balance")


@query(f"""SELECT asset_uid, address, sum(delta) AS balance, (SELECT strftime(max(block_time), '%Y-%m-%d') FROM t WHERE l_orderkey = (SELECT max(l_orderkey) FROM t)) AS as_of
FROM leg WHERE address NOT IN ('{ZERO}', '{fx.DEAD}') GROUP BY ALL HAVING sum(delta) > 0""")
def ls50_balances_head(spark, sf):
    """After the newest block, without instants. A block of the tables has several times; its latest is taken."""
    t = fx.transfers(spark, sf).withColumn("block", F.struct(F.substring("tx_hash", 3, 20).cast("long"), "block_time"))
    return ledger.balances_at_head(t).select("asset_uid", "address", "balance", F.date_format("as_of", "yyyy-MM-dd").alias("as_of"))


@query(f"""SELECT asset_uid, address, balance, strftime("end", '%Y-%m') AS since, strftime(until, '%Y-%m') AS until FROM (
SELECT *, lead("end") OVER (PARTITION BY asset_uid, address ORDER BY "end") AS until FROM (
SELECT asset_uid, address, "end", sum(d) OVER (PARTITION BY asset_uid, address ORDER BY "end") AS balance FROM (
SELECT asset_uid, address, w."end", sum(delta) AS d FROM leg JOIN w ON block_time >= start AND block_time < w."end" GROUP BY ALL)))
WHERE balance > 0 AND address NOT IN ('{ZERO}', '{fx.DEAD}')""")
def ls50_balance_intervals(spark, sf):
    held = ledger.balance_intervals(fx.transfers(spark, sf), fx.month_list(spark, sf).select(F.col("end").alias("as_of"), "month"))
    return held.select("asset_uid", "address", "balance", F.date_format("as_of", "yyyy-MM").alias("since"), F.date_format("until", "yyyy-MM").alias("until"))


_SUPPLY = """(SELECT u.asset_uid, u.window_id, coalesce(sum(CASE WHEN lower(from_address) IN ('{z}', '{d}') THEN amount WHEN lower(to_address) IN ('{z}', '{d}') THEN -amount END), 0) AS total_supply
FROM u LEFT JOIN t ON t.asset_uid = u.asset_uid AND block_time < u."end" GROUP BY ALL)""".format(z=ZERO, d=fx.DEAD)


@query(f"SELECT * FROM {_SUPPLY}")
def ls51_supply(spark, sf):
    s = ledger.supply_at(fx.transfers(spark, sf), fx.month_list(spark, sf).select(F.col("end").alias("as_of"), "month"))
    return asof.exact_state(s, fx.month_list(spark, sf)).select("asset_uid", "window_id", "total_supply")


@query(
    f"""SELECT asset_uid, held, negative, CASE WHEN negative > 0 THEN false ELSE held = r END AS reconciled FROM (SELECT asset_uid, sum(CASE WHEN b > 0 THEN b ELSE 0 END) AS held, count(*) FILTER (b < 0) AS negative, max(r) AS r
FROM (SELECT asset_uid, address, sum(delta) AS b FROM leg WHERE address NOT IN ('{ZERO}', '{fx.DEAD}') GROUP BY ALL) JOIN (SELECT asset_uid, sum(amount) AS r FROM t GROUP BY ALL) USING (asset_uid) GROUP BY ALL)"""
)
def ls52_reconcile_ledger(spark, sf):
    t = fx.transfers(spark, sf)
    return ledger.reconcile_ledger(t, t.groupBy("asset_uid").agg(F.sum("amount").alias("total_supply"))).drop("total_supply")


@query(
    f"""SELECT f.*, g.address AS top_recipient, round(g.v / g.v_all, 6) AS top_share FROM (SELECT asset_uid, count(*) AS transfers, count(*) FILTER (fb) AS mints, count(*) FILTER (tb AND NOT fb) AS burns,
  coalesce(sum(amount) FILTER (fb), 0) AS minted, strftime(min(block_time) FILTER (fb), '%Y-%m-%d') AS first_mint FROM k GROUP BY ALL) f
JOIN (SELECT asset_uid, address, v, sum(v) OVER (PARTITION BY asset_uid) AS v_all, row_number() OVER (PARTITION BY asset_uid ORDER BY v DESC, address) AS rn FROM
  (SELECT asset_uid, lower(to_address) AS address, coalesce(sum(amount) FILTER (from_address = '{ZERO}'), 0) AS v FROM t GROUP BY ALL)) g ON g.asset_uid = f.asset_uid AND rn = 1"""
)
def ls53_issuance(spark, sf):
    out = ledger.issuance_profile(fx.transfers(spark, sf))
    return out.withColumn("first_mint", F.date_format("first_mint", "yyyy-MM-dd")).withColumn("top_share", F.round("top_share", 6))


@query("""SELECT asset_uid, kind, count(*) AS n, sum(amount) AS amount FROM k GROUP BY ALL""")
def ls54_kinds(spark, sf):
    return fx.classified(spark, sf).groupBy("asset_uid", "kind").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query("""SELECT asset_uid, bool_and(kind = 'secondary') AND max(CASE WHEN i.a IS NULL THEN 1 ELSE 0 END) = 1 AS invisible_issuance FROM k LEFT JOIN (SELECT DISTINCT asset_uid AS a FROM iss) i ON i.a = k.asset_uid GROUP BY asset_uid""")
def ls55_invisible_issuance(spark, sf):
    return cl.invisible_issuance(fx.classified(spark, sf), fx.lists(spark)[0])


@query("""SELECT asset_uid, category, count(*) AS n, sum(amount) AS amount FROM k GROUP BY ALL""")
def ls56_categories(spark, sf):
    return fx.classified(spark, sf).groupBy("asset_uid", "category").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


# ---- as-of lookups


_SNAP = """(SELECT s.asset_uid, w.window_id, arg_max(total_supply, (as_of, source)) FILTER (total_supply IS NOT NULL) AS total_supply, arg_max(market_value_usd, (as_of, source)) FILTER (market_value_usd IS NOT NULL) AS market_value_usd,
  arg_max(holder_count, (as_of, source)) FILTER (holder_count IS NOT NULL) AS holder_count FROM s JOIN w ON as_of <= w."end" + INTERVAL 1 HOUR GROUP BY ALL)"""


@query(f"SELECT * FROM {_SNAP}")
def ls57_latest_snapshot(spark, sf):
    return asof.latest_snapshot(fx.snapshots(spark, sf), fx.month_list(spark, sf)).select("asset_uid", "window_id", "total_supply", "market_value_usd", "holder_count")


@query("""SELECT b.asset_uid, h.window_id, b.window_id AS month, count(*) AS n, sum(balance) AS held FROM b JOIN (SELECT asset_uid, w.window_id, max(as_of) AS as_of FROM b, w
WHERE b.as_of <= w."end" - INTERVAL 10 DAY + INTERVAL 1 HOUR GROUP BY ALL) h ON h.asset_uid = b.asset_uid AND h.as_of = b.as_of GROUP BY ALL""")
def ls58_latest_holders(spark, sf):
    w = fx.month_list(spark, sf).withColumn("end", F.col("end") - F.expr("interval 10 days"))
    h = asof.latest_holders(fx.balances(spark, sf), w)
    return h.groupBy("asset_uid", "window_id", F.date_format(F.col("as_of") - F.expr("interval 1 day"), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum("balance").alias("held"))


@query("""SELECT asset_uid, window_id, count(*) AS n, sum(balance) AS held FROM b GROUP BY ALL""")
def ls59_exact_state(spark, sf):
    return _held(spark, sf).groupBy("asset_uid", "window_id").agg(F.count("*").alias("n"), F.sum("balance").alias("held"))


@query(
    f"""SELECT o.asset_uid, o.window_id, CASE WHEN coalesce(total_supply, observed) > 0 THEN coalesce(total_supply, observed) END AS denominator, CASE WHEN coalesce(total_supply, observed) <= 0 THEN 'supply_not_positive' END AS error_code,
concat_ws(',', CASE WHEN total_supply IS NULL THEN 'supply_from_holders' END, CASE WHEN listed < 0.99 * holder_count THEN 'truncated_holder_list' END, CASE WHEN observed > total_supply * (1 + 1e-9) THEN 'holders_exceed_supply' END) AS warnings
FROM (SELECT asset_uid, window_id, sum(balance) AS observed, count(*) AS listed FROM b GROUP BY ALL) o LEFT JOIN {_SNAP} s ON o.asset_uid = s.asset_uid AND o.window_id = s.window_id"""
)
def ls60_share_denominator(spark, sf):
    state = asof.latest_snapshot(fx.snapshots(spark, sf), fx.month_list(spark, sf))
    o = _held(spark, sf).groupBy("asset_uid", "window_id").agg(F.sum("balance").alias("observed"), F.count("*").alias("listed"))
    out = asof.share_denominator(state.select("asset_uid", "window_id", "total_supply", "holder_count"), o)
    return out.select("asset_uid", "window_id", "denominator", "error_code", F.array_join("warnings", ",").alias("warnings"))


@query("""SELECT asset_uid, arg_min(symbol, (as_of, source)) AS symbol FROM s GROUP BY ALL""")
def ls61_symbol(spark, sf):
    return asof.first_symbol(fx.snapshots(spark, sf))


# ---- measures


_VOL = """(SELECT u.asset_uid, u.window_id, m.mode, count(p.kind) AS n, CASE WHEN count(p.kind) = 0 THEN 0.0 ELSE sum(amount) END AS volume_native, CASE WHEN count(p.kind) = 0 THEN 0.0 ELSE sum(amount_usd) END AS volume_usd, count(p.kind) - count(amount_usd) AS nulls_usd
FROM u CROSS JOIN (VALUES ('all'), ('secondary_only'), ('primary_only')) m(mode) LEFT JOIN p ON p.asset_uid = u.asset_uid AND p.window_id = u.window_id
  AND (m.mode = 'all' OR m.mode = 'secondary_only' AND p.kind = 'secondary' OR m.mode = 'primary_only' AND p.kind IN ('mint', 'burn')) GROUP BY ALL)"""
_ACT = """(SELECT DISTINCT asset_uid, window_id, lower(a) AS address FROM (SELECT asset_uid, window_id, from_address AS a, kind FROM p UNION ALL SELECT asset_uid, window_id, to_address, kind FROM p)
WHERE kind = 'secondary' AND lower(a) NOT IN ('{z}', '{d}'))""".format(z=ZERO, d=fx.DEAD)
_HOLD = """(SELECT b.*, x.address IS NULL AS retained, sum(balance) OVER (PARTITION BY b.asset_uid, b.window_id) AS z FROM b LEFT JOIN exc x ON b.asset_uid = x.asset_uid AND b.address = x.address)"""


def _volumes(spark, sf, t=None):
    """Transfers are used twice here, so they are joined once, as in all that follow."""
    t = fx.kept_transfers(spark, sf) if t is None else t
    return measures.volumes(_placed(spark, sf, t), _universe(spark, sf, t))


def _active(spark, sf, t=None):
    return measures.active(_placed(spark, sf, t)).filter("mode = 'secondary_only'")


def _spread(spark, sf, t=None):
    """The sum of all holders is the denominator of shares here, so that they stay within one."""
    return measures.concentration(settled(measures.prepare_holders(_held(spark, sf, t), fx.lists(spark)[1])))


@query(f"SELECT asset_uid, window_id, mode, n, volume_native, round(volume_usd, 2) AS volume_usd, nulls_usd FROM {_VOL}")
def ls62_total_volume(spark, sf):
    return _volumes(spark, sf).select("asset_uid", "window_id", "mode", "n", "volume_native", F.round("volume_usd", 2).alias("volume_usd"), "nulls_usd")


@query("""SELECT asset_uid, window_id, count(*) FILTER (kind = 'unclassified') AS n_unclassified, round(avg(CASE WHEN kind = 'unclassified' THEN 1.0 ELSE 0.0 END), 6) AS share_unclassified FROM p GROUP BY ALL""")
def ls63_unclassified(spark, sf):
    return measures.unclassified_share(_placed(spark, sf)).select("asset_uid", "window_id", "n_unclassified", *_r("share_unclassified"))


@query(f"""SELECT v.asset_uid, v.window_id, mode, round(CASE WHEN total_supply > 0 THEN volume_native / total_supply END, 6) AS turnover_native, round(CASE WHEN market_value_usd > 0 THEN volume_usd / market_value_usd END, 6) AS turnover_usd
FROM {_VOL} v LEFT JOIN {_SNAP} s ON v.asset_uid = s.asset_uid AND v.window_id = s.window_id""")
def ls64_turnover(spark, sf):
    out = measures.turnover(_volumes(spark, sf), asof.latest_snapshot(fx.snapshots(spark, sf), fx.month_list(spark, sf)))
    return out.select("asset_uid", "window_id", "mode", *_r("turnover_native", "turnover_usd"))


@query(f"SELECT asset_uid, window_id, count(*) AS active_addresses FROM {_ACT} GROUP BY ALL")
def ls65_active_addresses(spark, sf):
    return measures.active_counts(_active(spark, sf)).drop("mode")


@query(f"""SELECT v.asset_uid, v.window_id, round(volume_native / a.n, 6) AS volume_per_active FROM {_VOL} v LEFT JOIN (SELECT asset_uid, window_id, count(*) AS n FROM {_ACT} GROUP BY ALL) a
ON a.asset_uid = v.asset_uid AND a.window_id = v.window_id WHERE mode = 'secondary_only'""")
def ls66_volume_per_active(spark, sf):
    t = fx.kept_transfers(spark, sf)
    v = _volumes(spark, sf, t).filter("mode = 'secondary_only'")
    return measures.volume_per_active(v, measures.active_counts(_active(spark, sf, t))).select("asset_uid", "window_id", *_r("volume_per_active"))


@query(f"""SELECT h.asset_uid, h.window_id, round(coalesce(a.n, 0) / h.listed, 6) AS active_holder_ratio FROM (SELECT asset_uid, window_id, count(*) AS listed FROM b GROUP BY ALL) h
LEFT JOIN (SELECT asset_uid, window_id, count(*) AS n FROM {_ACT} GROUP BY ALL) a ON a.asset_uid = h.asset_uid AND a.window_id = h.window_id""")
def ls67_active_holder_ratio(spark, sf):
    t = fx.kept_transfers(spark, sf)
    listed = _held(spark, sf, t).groupBy("asset_uid", "window_id").agg(F.count("*").alias("listed")).withColumn("holder_count", F.lit(None).cast("long"))
    return measures.active_holder_ratio(measures.active_counts(_active(spark, sf, t)), listed).select("asset_uid", "window_id", *_r("active_holder_ratio"))


@query(f"""SELECT h.asset_uid, h.window_id, round(coalesce(sum(balance) FILTER (NOT EXISTS (SELECT 1 FROM {_ACT} a WHERE a.asset_uid = h.asset_uid AND a.window_id = h.window_id AND a.address = h.address)), 0) / max(z), 6) AS dormancy FROM {_HOLD} h GROUP BY ALL""")
def ls68_dormancy(spark, sf):
    t = fx.kept_transfers(spark, sf)
    h = settled(_held(spark, sf, t))
    whole = h.groupBy("asset_uid", "window_id").agg(F.sum("balance").alias("denominator"))
    return measures.dormancy(h, _active(spark, sf, t), whole).select("asset_uid", "window_id", *_r("dormancy"))


_SPREAD = f"""SELECT asset_uid, window_id, count(*) FILTER (retained) AS retained_holders, round(sum(balance) FILTER (retained AND rn <= 10) / max(z), 6) AS top_share, round(sum(balance * balance) FILTER (retained) / (max(z) * max(z)) * 10000, 6) AS hhi,
  round(sum(balance) FILTER (retained) / max(z), 6) AS coverage, round(sum(balance * balance) FILTER (retained) / (sum(balance) FILTER (retained) * sum(balance) FILTER (retained)) * 10000, 6) AS conditional_hhi,
  round(sum(balance) FILTER (retained AND rn <= 10) / sum(balance) FILTER (retained), 6) AS conditional_top_share
FROM (SELECT *, row_number() OVER (PARTITION BY asset_uid, window_id, retained ORDER BY balance DESC, address) AS rn FROM {_HOLD}) GROUP BY ALL"""


@query(_SPREAD)
def ls69_concentration(spark, sf):
    """Operators 69 to 74 in one aggregation."""
    return _spread(spark, sf).select("asset_uid", "window_id", "retained_holders", *_r("top_share", "hhi", "coverage", "conditional_hhi", "conditional_top_share"))


@query(f"SELECT asset_uid, window_id, coverage, conditional_hhi, round(coverage_raw * coverage_raw * cond, 4) AS identity_hhi FROM (SELECT asset_uid, window_id, round(sum(balance) FILTER (retained) / max(z), 6) AS coverage, round(sum(balance * balance) FILTER (retained) / (sum(balance) FILTER (retained) * sum(balance) FILTER (retained)) * 10000, 6) AS conditional_hhi, sum(balance) FILTER (retained) / max(z) AS coverage_raw, sum(balance * balance) FILTER (retained) / (sum(balance) FILTER (retained) * sum(balance) FILTER (retained)) * 10000 AS cond FROM {_HOLD} GROUP BY ALL)")
def ls72_conditional_identity(spark, sf):
    """The HHI equals the squared coverage times the conditional one."""
    return _spread(spark, sf).select("asset_uid", "window_id", *_r("coverage", "conditional_hhi"), F.round("hhi", 4).alias("identity_hhi"))


@query(f"""SELECT v.asset_uid, v.window_id, volume_native AS value, 'total_volume' AS metric, 'ledger' AS sources, n AS n_records, 'secondary_only' AS mode, 'native' AS denomination, '' AS exclusions,
CASE WHEN n > 0 AND volume_native IS NULL THEN 'null_amounts' ELSE '' END AS warnings FROM {_VOL} v WHERE mode = 'secondary_only'""")
def ls75_provenance(spark, sf):
    t = fx.kept_transfers(spark, sf)
    v = _volumes(spark, sf, t).filter("mode = 'secondary_only'").join(status.contributing_sources(t), "asset_uid")
    none = F.array().cast("array<string>")
    p = measures.provenance("total_volume", "secondary_only", "native", F.col("sources"), F.col("n"), none, F.array_compact(F.array(F.when(F.col("nulls_native") > 0, F.lit("null_amounts")))))
    lists = {c: F.array_join(F.col("p")[c], ",").alias(c) for c in ("sources", "exclusions", "warnings")}
    return v.withColumn("p", p).select("asset_uid", "window_id", F.col("volume_native").alias("value"), "p.metric", lists["sources"], "p.n_records", "p.mode", "p.denomination", lists["exclusions"], lists["warnings"])


# ---- report, trend, panel


def _status(t):
    assets = t.select("asset_uid").distinct().withColumn("n", F.substring("asset_uid", -2, 2).cast("int"))
    missing = F.when(F.col("n") == 3, F.array(F.lit("holders"))).otherwise(F.array().cast("array<string>"))
    return assets.select("asset_uid", missing.alias("missing_kinds"), (F.col("n") < 20).alias("reconciliation_checked"), F.when(F.col("n") < 10, F.col("n") != 5).alias("reconciled"))


def _report(spark, sf, t=None):
    t = fx.kept_transfers(spark, sf) if t is None else t
    inputs = report.Inputs(fx.classified(spark, sf, t), settled(fx.balances(spark, sf, t)), settled(fx.snapshots(spark, sf)), fx.lists(spark)[1], _status(t))
    return report.build_report(inputs, fx.month_list(spark, sf))


_KEPT = f"""(SELECT h.asset_uid, h.window_id, count(*) AS observed_n, count(*) FILTER (retained) AS listed, sum(balance) FILTER (retained) AS obs, sum(balance * balance) FILTER (retained) AS bb, sum(balance) FILTER (retained AND rn <= 10) AS top,
  sum(CASE WHEN a.address IS NULL THEN balance ELSE 0 END) FILTER (retained) AS idle FROM (SELECT *, row_number() OVER (PARTITION BY asset_uid, window_id, retained ORDER BY balance DESC, address) AS rn FROM {_HOLD}) h
  LEFT JOIN {_ACT} a ON a.asset_uid = h.asset_uid AND a.window_id = h.window_id AND a.address = h.address GROUP BY ALL)"""
_GUARD = "CASE WHEN {0} <= 1 + 1e-9 THEN {0} END"
#: All nine measures; asset 3 lacks holders, that is unmeasured, and the ledger of asset 5 does not reconcile.
_REPORT = f"""(SELECT v.asset_uid, v.window_id, n AS n_transfers, coalesce(a.n_active, 0) AS active, d, CASE WHEN m AND total_supply > 0 THEN volume_native / total_supply END AS turnover, CASE WHEN m THEN volume_native / a.n_active END AS volume_per_active,
  CASE WHEN ok THEN coalesce(a.n_active, 0) / h.observed_n END AS active_holder_ratio, CASE WHEN ok THEN {_GUARD.format("idle / d")} END AS dormancy, CASE WHEN ok THEN {_GUARD.format("top / d")} END AS top_share,
  CASE WHEN ok THEN {_GUARD.format("bb / (d * d)")} END * 10000 AS hhi, CASE WHEN ok THEN {_GUARD.format("obs / d")} END AS coverage, CASE WHEN ok AND obs > 0 THEN bb / (obs * obs) * 10000 END AS conditional_hhi, CASE WHEN ok AND obs > 0 THEN top / obs END AS conditional_top_share
FROM (SELECT *, right(asset_uid, 2) <> '03' AS m, right(asset_uid, 2) NOT IN ('03', '05') AS ok FROM {_VOL} WHERE mode = 'secondary_only') v LEFT JOIN {_SNAP} s ON v.asset_uid = s.asset_uid AND v.window_id = s.window_id
LEFT JOIN (SELECT asset_uid, window_id, count(*) AS n_active FROM {_ACT} GROUP BY ALL) a ON a.asset_uid = v.asset_uid AND a.window_id = v.window_id
LEFT JOIN {_KEPT} h ON h.asset_uid = v.asset_uid AND h.window_id = v.window_id
LEFT JOIN (SELECT h.asset_uid, h.window_id, CASE WHEN coalesce(total_supply, obs, 0) > 0 THEN coalesce(total_supply, obs) END AS d FROM {_KEPT} h LEFT JOIN {_SNAP} s ON s.asset_uid = h.asset_uid AND s.window_id = h.window_id) e ON e.asset_uid = v.asset_uid AND e.window_id = v.window_id)"""
_NINE = ("turnover", "volume_per_active", "active_holder_ratio", "dormancy", "top_share", "hhi", "coverage", "conditional_hhi", "conditional_top_share")
_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in _NINE)


@query(f"SELECT asset_uid, window_id, n_transfers, active, {_ROUNDED} FROM {_REPORT}")
def ls76_report(spark, sf):
    """With 77 and 78: unmeasured and withheld assets keep their rows."""
    return _report(spark, sf).select("asset_uid", "window_id", "n_transfers", F.coalesce("active_addresses", F.lit(0)).alias("active"), *_r(*_NINE))


@query(f"""SELECT r.asset_uid, 'P' || CAST(CAST(right(r.asset_uid, 2) AS INT) AS VARCHAR) AS symbol, r.window_id, strftime(start, '%Y-%m-%d') AS window_start, strftime("end", '%Y-%m-%d') AS window_end, start_block, end_block, head_block, n_transfers, {_ROUNDED}, x.dropped AS dropped_transfers, z.sources
FROM {_REPORT} r JOIN w ON w.window_id = r.window_id LEFT JOIN (SELECT window_id, min(l_orderkey) AS start_block, max(l_orderkey) AS end_block FROM t GROUP BY ALL) k ON k.window_id = r.window_id, (SELECT max(l_orderkey) AS head_block FROM t),
(SELECT asset_uid, count(*) FILTER (dropped) AS dropped FROM {_REPLAYED} GROUP BY ALL) x, (SELECT asset_uid, string_agg(source, ', ' ORDER BY source) AS sources FROM (SELECT asset_uid, source FROM s UNION SELECT asset_uid, source FROM t) GROUP BY ALL) z
WHERE x.asset_uid = r.asset_uid AND z.asset_uid = r.asset_uid""")
def ls79_report_rows(spark, sf):
    t, w = fx.kept_transfers(spark, sf, "tx_hash", "bucket", "seq"), fx.month_list(spark, sf)
    blocks = _blocks(spark, sf, t)
    ranges = windows.block_ranges(blocks, w).crossJoin(F.broadcast(blocks.agg(F.max("number").alias("head_block"))))
    dropped = ledger.dropped_counts(ledger.drop_implausible(t), t.select("asset_uid").distinct())
    out = report.export_rows(_report(spark, sf, t), status.contributing_sources(t, fx.snapshots(spark, sf)), w, ranges, dropped)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return out.select("asset_uid", "symbol", "window_id", day("window_start"), day("window_end"), "start_block", "end_block", "head_block", "n_transfers", *_r(*_NINE), "dropped_transfers", "sources")


_PANEL = f"""(SELECT u.asset_uid, u.window_id, coalesce(sum(amount) FILTER (category = 'creation'), 0) AS v_creation, coalesce(sum(amount) FILTER (category = 'residual'), 0) AS v_residual, count(category) AS n_all, coalesce(sum(amount), 0) AS v_all,
  count(category) FILTER (category = 'issuer_linked') AS n_issuer_linked, count(category) FILTER (category = 'unresolved') AS n_unresolved FROM u LEFT JOIN p ON p.asset_uid = u.asset_uid AND p.window_id = u.window_id GROUP BY ALL)"""


@query(f"""SELECT asset_uid, CASE WHEN n < 2 THEN 'insufficient data' WHEN a = 0 AND z = 0 THEN 'flat at zero' WHEN a = 0 THEN 'rising from zero' WHEN (z - a) / abs(a) > 0.1 THEN 'rising' WHEN (z - a) / abs(a) < -0.1 THEN 'falling' ELSE 'flat' END AS direction
FROM (SELECT asset_uid, arg_min(volume_native, window_id) AS a, arg_max(volume_native, window_id) AS z, count(*) AS n FROM {_VOL} WHERE mode = 'secondary_only' GROUP BY ALL)""")
def ls80_trend(spark, sf):
    v = _volumes(spark, sf).filter("mode = 'secondary_only'").join(F.broadcast(fx.month_list(spark, sf).select("window_id", "start")), "window_id")
    return report.direction(v.select("asset_uid", F.lit("volume").alias("metric"), "start", F.col("volume_native").alias("value"))).drop("metric")


def _panel(spark, sf):
    t = settled(fx.transfers(spark, sf).select("asset_uid", "block_time", "from_address", "to_address", "amount"))
    h = settled(fx.balances(spark, sf, t))
    t = fx.classified(spark, sf, t)
    supply = h.groupBy("asset_uid", "as_of").agg(F.sum("balance").alias("total_supply")).withColumn("source", F.lit("ledger"))
    return panel.build_panel(t, fx.month_list(spark, sf), t, h, supply, fx.lists(spark)[1])


@query(f"""SELECT p.asset_uid, p.window_id, v_creation, v_residual, n_all, v_all, n_issuer_linked, n_unresolved, round(v_all / z, 6) AS t_all, round(v_residual / z, 6) AS t_res, round(CASE WHEN v_residual > 0 THEN v_all / v_residual END, 6) AS f,
round(CASE WHEN v_all > 0 THEN 1 - v_residual / v_all END, 6) AS x FROM {_PANEL} p LEFT JOIN (SELECT asset_uid, window_id, sum(balance) AS z FROM b GROUP BY ALL) z ON z.asset_uid = p.asset_uid AND z.window_id = p.window_id""")
def ls82_panel_activity(spark, sf):
    """With 81: every asset in every month."""
    return _panel(spark, sf).select("asset_uid", "window_id", "v_creation", "v_residual", "n_all", "v_all", "n_issuer_linked", "n_unresolved", *_r("t_all", "t_res", "f", "x"))


_PART = """(SELECT DISTINCT asset_uid, window_id, lower(a) AS address FROM (SELECT asset_uid, window_id, unnest([from_address, to_address]) AS a FROM p WHERE category = 'residual' AND amount > 0 AND lower(from_address) <> lower(to_address)))"""


@query(f"""SELECT h.asset_uid, h.window_id, round(avg(CASE WHEN q.address IS NULL THEN 0.0 ELSE 1.0 END), 6) AS participation, round(coalesce(sum(balance) FILTER (q.address IS NULL), 0) / max(z), 6) AS dormancy
FROM {_HOLD} h LEFT JOIN {_PART} q ON q.asset_uid = h.asset_uid AND q.window_id = h.window_id AND q.address = h.address GROUP BY ALL""")
def ls83_participation(spark, sf):
    return _panel(spark, sf).filter("holders IS NOT NULL").select("asset_uid", "window_id", *_r("participation", "dormancy"))


_OWNED = f"""(SELECT asset_uid, window_id, h_all, coverage, h_ret, CASE WHEN c >= 0.5 THEN h_cond END AS h_cond, k_all, k_ret, CASE WHEN c >= 0.5 THEN k_cond END AS k_cond, c >= 0.5 AS assessable FROM (
SELECT asset_uid, window_id, round(sum(balance * balance) / (max(z) * max(z)) * 10000, 6) AS h_all, coalesce(sum(balance) FILTER (retained), 0) / max(z) AS c, round(coalesce(sum(balance) FILTER (retained), 0) / max(z), 6) AS coverage,
  round(coalesce(sum(balance * balance) FILTER (retained), 0) / (max(z) * max(z)) * 10000, 6) AS h_ret, round(sum(balance * balance) FILTER (retained) / (sum(balance) FILTER (retained) * sum(balance) FILTER (retained)) * 10000, 6) AS h_cond,
  round(sum(balance) FILTER (ra <= 10) / max(z), 6) AS k_all, round(coalesce(sum(balance) FILTER (retained AND rr <= 10), 0) / max(z), 6) AS k_ret, round(sum(balance) FILTER (retained AND rr <= 10) / sum(balance) FILTER (retained), 6) AS k_cond
FROM (SELECT *, row_number() OVER (PARTITION BY asset_uid, window_id ORDER BY balance DESC, address) AS ra, row_number() OVER (PARTITION BY asset_uid, window_id, retained ORDER BY balance DESC, address) AS rr FROM {_HOLD}) GROUP BY ALL))"""


@query(f"SELECT * FROM {_OWNED}")
def ls84_ownership(spark, sf):
    return _panel(spark, sf).filter("holders IS NOT NULL").select("asset_uid", "window_id", *_r("h_all", "coverage", "h_ret", "h_cond", "k_all", "k_ret", "k_cond"), "assessable")


@query(f"""SELECT asset_uid, count(*) FILTER (v_all > 0) AS months_with_volume, round(median(x), 6) AS x_median, round(min(x), 6) AS x_min, round(max(x), 6) AS x_max, round(median(f), 6) AS f_median, round(min(f), 6) AS f_min, round(max(f), 6) AS f_max
FROM (SELECT *, CASE WHEN v_residual > 0 THEN v_all / v_residual END AS f, CASE WHEN v_all > 0 THEN 1 - v_residual / v_all END AS x FROM {_PANEL}) GROUP BY ALL""")
def ls85_month_summary(spark, sf):
    out = panel.month_summary(_panel(spark, sf))
    return out.select("asset_uid", "months_with_volume", *_r("x_median", "x_min", "x_max", "f_median", "f_min", "f_max"))


_PICK = [f"tpch:0x{n:040d}" for n in (7, 3, 99)]


@query(f"""SELECT q.position, q.asset_uid, p.v_all, p.n_all FROM (VALUES (0, '{_PICK[0]}'), (1, '{_PICK[1]}'), (2, '{_PICK[2]}')) q(position, asset_uid) LEFT JOIN (SELECT * FROM {_PANEL} WHERE window_id = '1998-06') p ON p.asset_uid = q.asset_uid""")
def ls86_selected(spark, sf):
    return panel.selected(_panel(spark, sf), _PICK, "1998-06").select("position", "asset_uid", "v_all", "n_all")


_OWN = ("coverage", "h_all", "h_ret", "h_cond", "k_all", "k_ret", "k_cond")


@query(f"""SELECT CASE WHEN window_id = a THEN 'first' ELSE 'last' END AS place, unnest([{", ".join(f"'{n}'" for n in _OWN)}]) AS name, unnest([{", ".join(_OWN)}]) AS value FROM {_OWNED}, (SELECT min(window_id) AS a, max(window_id) AS z FROM u) WHERE asset_uid = '{_PICK[0]}' AND window_id IN (a, z)
UNION ALL SELECT 'months', unnest(['f_median', 'f_min', 'f_max']), unnest([round(median(f), 6), round(min(f), 6), round(max(f), 6)]) FROM (SELECT CASE WHEN v_residual > 0 THEN v_all / v_residual END AS f FROM {_PANEL} WHERE asset_uid = '{_PICK[1]}')""")
def ls87_figures(spark, sf):
    return panel.figures(_panel(spark, sf), _PICK[0], _PICK[1]).select("place", "name", *_r("value"))


@query("""SELECT strftime(min(start), '%Y-%m-%d') AS first_start, strftime(max("end"), '%Y-%m-%d') AS last_end, count(DISTINCT window_id) AS windows, (SELECT max(l_orderkey) FROM t) AS head_block,
(SELECT min(l_orderkey) FROM t WHERE window_id = (SELECT max(window_id) FROM w)) AS last_window_block FROM u""")
def ls88_span(spark, sf):
    out = panel.span(_universe(spark, sf), _blocks(spark, sf))
    return out.select(F.date_format("first_start", "yyyy-MM-dd").alias("first_start"), F.date_format("last_end", "yyyy-MM-dd").alias("last_end"), "windows", "head_block", "last_window_block")


# ---- reconciliation and ad-hoc SQL

_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_uid, source ORDER BY as_of DESC) AS rn FROM s) WHERE rn = 1)"
_LONG = f"(SELECT asset_uid, source, as_of, 'total_supply' AS field, total_supply AS value FROM {_LATEST} WHERE total_supply IS NOT NULL UNION ALL SELECT asset_uid, source, as_of, 'market_value_usd', market_value_usd FROM {_LATEST} WHERE market_value_usd IS NOT NULL UNION ALL SELECT asset_uid, source, as_of, 'holder_count', holder_count FROM {_LATEST} WHERE holder_count IS NOT NULL)"
_PAIRS = f"""(SELECT a.asset_uid, a.field, a.source AS source_a, b.source AS source_b, CAST(a.value AS DOUBLE) AS va, CAST(b.value AS DOUBLE) AS vb, CASE WHEN greatest(abs(a.value), abs(b.value)) = 0 THEN 0 ELSE abs(a.value - b.value) / greatest(abs(a.value), abs(b.value)) END AS d,
  abs(epoch_us(a.as_of) - epoch_us(b.as_of)) AS gap FROM {_LONG} a JOIN {_LONG} b ON a.asset_uid = b.asset_uid AND a.field = b.field AND a.source < b.source)"""


@query(f"SELECT asset_uid, source, strftime(as_of, '%Y-%m-%d') AS as_of, total_supply FROM {_LATEST}")
def ls89_latest_by_source(spark, sf):
    return reconcile.latest_by_source(fx.snapshots(spark, sf)).select("asset_uid", "source", F.date_format("as_of", "yyyy-MM-dd").alias("as_of"), "total_supply")


@query(f"SELECT asset_uid, field, source_a, source_b, round(d, 6) AS relative_difference, round(gap / 3600000000, 6) AS gap_hours, gap > 86400000000 AS stale FROM {_PAIRS} WHERE d > 0.01")
def ls90_disagreements(spark, sf):
    """With 91: the staleness flag and the gap."""
    found = reconcile.disagreements(reconcile.comparisons(reconcile.long_fields(fx.snapshots(spark, sf))))
    return found.select("asset_uid", "field", "source_a", "source_b", *_r("relative_difference", "gap_hours"), "stale")


@query(f"SELECT asset_uid, field FROM {_LONG} GROUP BY ALL HAVING count(DISTINCT source) = 1")
def ls92_uncheckable(spark, sf):
    return reconcile.uncheckable(reconcile.long_fields(fx.snapshots(spark, sf)))


@query(f"SELECT count(*) AS compared, count(*) FILTER (d > 0.01) AS disagreements FROM {_PAIRS}")
def ls93_agreement(spark, sf):
    return reconcile.agreement(reconcile.comparisons(reconcile.long_fields(fx.snapshots(spark, sf))))


def _readable(v: str) -> str:
    # values here are counts below 1,000 or amounts with two decimals
    return f"CASE WHEN abs({v}) >= 1000 THEN format('{{:,}}', CAST(round_even({v}, 0) AS BIGINT)) ELSE format('{{:.4g}}', {v}) END"


@query(f"""SELECT asset_uid, field, source_a, source_b, asset_uid || ' ' || field || ': ' || source_a || '=' || {_readable("va")} || ' vs ' || source_b || '=' || {_readable("vb")} || format(' ({{:.1f}}% apart)', d * 100)
|| CASE WHEN gap > 86400000000 THEN ' (observations too far apart to compare)' ELSE '' END AS description FROM {_PAIRS} WHERE d > 0.01""")
def ls99_descriptions(spark, sf):
    found = reconcile.disagreements(reconcile.comparisons(reconcile.long_fields(fx.snapshots(spark, sf))))
    return reconcile.describe(found).select("asset_uid", "field", "source_a", "source_b", "description")


@query("""SELECT symbol, kind, count(*) AS n, sum(amount) AS amount FROM k JOIN (SELECT DISTINCT asset_uid, symbol FROM s) USING (asset_uid) GROUP BY ALL""")
def ls94_volume_by_symbol(spark, sf):
    names = fx.snapshots(spark, sf).select("asset_uid", "symbol").dropDuplicates()
    return fx.classified(spark, sf).join(names, "asset_uid").groupBy("symbol", "kind").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query(f"""SELECT CASE WHEN from_address = '{ZERO}' THEN 'mint' WHEN to_address IN ('{ZERO}', '{fx.DEAD}') THEN 'burn' ELSE 'secondary' END AS kind, count(*) AS n_transfers, sum(amount) AS volume, count(DISTINCT from_address) AS distinct_senders, count(DISTINCT to_address) AS distinct_recipients
FROM t WHERE block_time >= TIMESTAMP '1997-06-01' AND block_time < TIMESTAMP '1997-07-01' GROUP BY 1""")
def ls95_activity_by_kind(spark, sf):
    t = fx.transfers(spark, sf).filter("block_time >= '1997-06-01' AND block_time < '1997-07-01'")
    kind = F.when(F.col("from_address") == ZERO, "mint").when(cl.is_burn(F.col("to_address")), "burn").otherwise("secondary")
    return t.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("n_transfers"), F.sum("amount").alias("volume"), F.count_distinct("from_address").alias("distinct_senders"), F.count_distinct("to_address").alias("distinct_recipients")
    )


@query(f"""SELECT h.asset_uid, max(z) AS supply, count(*) AS holders, round(sum(balance) FILTER (rn <= 10) / max(z), 6) AS top_10_share, round(sum(balance * balance) / (max(z) * max(z)) * 10000, 6) AS hhi,
round(coalesce(sum(balance) FILTER (a.address IS NULL), 0) / max(z), 6) AS dormancy FROM (SELECT *, row_number() OVER (PARTITION BY asset_uid ORDER BY balance DESC, address) AS rn FROM {_HOLD} WHERE window_id = '1998-06') h
LEFT JOIN (SELECT DISTINCT asset_uid, lower(x) AS address FROM (SELECT asset_uid, unnest([from_address, to_address]) AS x FROM t WHERE block_time >= TIMESTAMP '1998-06-01' AND block_time < TIMESTAMP '1998-07-01' AND from_address <> '{ZERO}' AND to_address NOT IN ('{ZERO}', '{fx.DEAD}'))) a
ON a.asset_uid = h.asset_uid AND a.address = h.address GROUP BY ALL""")
def ls96_holder_state(spark, sf):
    """One window's end for every asset: balances from all history, ranks, and the addresses of secondary transfers."""
    h = _held(spark, sf).filter("window_id = '1998-06'")
    t = fx.transfers(spark, sf).filter("block_time >= '1998-06-01' AND block_time < '1998-07-01'").filter((F.col("from_address") != ZERO) & ~cl.is_burn(F.col("to_address")))
    live = t.select("asset_uid", F.explode(F.array(F.lower("from_address"), F.lower("to_address"))).alias("address")).distinct().withColumn("live", F.lit(True))
    rank = F.row_number().over(Window.partitionBy("asset_uid").orderBy(F.desc("balance"), "address"))
    x = h.withColumn("r", rank).join(live, ["asset_uid", "address"], "left")
    b = F.col("balance")
    s = x.groupBy("asset_uid").agg(F.sum(b).alias("supply"), F.count("*").alias("holders"), F.sum(F.when(F.col("r") <= 10, b)).alias("top"), F.sum(b * b).alias("bb"), F.sum(F.when(F.col("live").isNull(), b).otherwise(0)).alias("idle"))
    z = F.col("supply")
    return s.select("asset_uid", "supply", "holders", F.round(F.col("top") / z, 6).alias("top_10_share"), F.round(F.col("bb") / (z * z) * 10000, 6).alias("hhi"), F.round(F.col("idle") / z, 6).alias("dormancy"))


@query("""SELECT tx_hash, log_index, lower(from_address) AS sender, lower(to_address) AS recipient, round(amount / 1000, 6) AS amount FROM t WHERE asset_uid = 'tpch:0x' || lpad('7', 40, '0') AND block_time >= TIMESTAMP '1999-01-01' - INTERVAL 30 DAY AND block_time < TIMESTAMP '1999-01-01'""")
def ls97_transfers_projection(spark, sf):
    end = F.lit("1999-01-01").cast("timestamp")
    t = fx.transfers(spark, sf).filter((F.col("asset_uid") == _PICK[0]) & (F.col("block_time") >= end - F.expr("interval 30 days")) & (F.col("block_time") < end))
    return t.select("tx_hash", "log_index", F.lower("from_address").alias("sender"), F.lower("to_address").alias("recipient"), F.round(F.col("amount") / 1000, 6).alias("amount"))


@query(f"""SELECT asset_uid, address, sum(delta) AS balance FROM leg WHERE address <> '{ZERO}' GROUP BY ALL HAVING sum(delta) > 0""")
def ls98_holders_aggregation(spark, sf):
    rows = ledger.legs(fx.transfers(spark, sf)).filter(F.col("address") != ZERO)
    return rows.groupBy("asset_uid", "address").agg(F.sum("delta").alias("balance")).filter("balance > 0")


@query("""SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS volume FROM events GROUP BY ALL""")
def stream_tumbling_volumes(spark, sf):
    e = fx.table(spark, sf, "events").withColumn("block_time", F.col("ts").cast("timestamp"))
    out = tumbling_volumes(e, key="event_type", amount="value")
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "n", F.round("volume", 4).alias("volume"))


@query(f"""SELECT v.asset_uid, v.window_id, round(CASE WHEN z > 0 THEN volume_native / z END, 6) AS turnover, s.top_share FROM {_VOL} v LEFT JOIN (SELECT asset_uid, window_id, sum(balance) AS z FROM b GROUP BY ALL) z ON z.asset_uid = v.asset_uid AND z.window_id = v.window_id
LEFT JOIN ({_SPREAD}) s ON s.asset_uid = v.asset_uid AND s.window_id = v.window_id WHERE mode = 'secondary_only'""")
def monthly_turnover(spark, sf):
    """The flagship query: monthly residual turnover and top-10 share per asset."""
    t = fx.kept_transfers(spark, sf)
    v = _volumes(spark, sf, t).filter("mode = 'secondary_only'")
    out = v.join(_spread(spark, sf, t).select("asset_uid", "window_id", "denominator", "top_share"), ["asset_uid", "window_id"], "left")
    return out.select("asset_uid", "window_id", F.round(F.when(F.col("denominator") > 0, F.col("volume_native") / F.col("denominator")), 6).alias("turnover"), *_r("top_share"))
