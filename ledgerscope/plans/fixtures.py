"""The driver's tables as transfers, snapshots, address lists and raw logs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerscope.functions.classify import classify
from ledgerscope.operators import ledger, windows
from ledgerscope.schemas import DEAD, ZERO
from ledgerscope.shared import settled

ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def address(prefix: Column, number: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.concat(prefix, number.cast("string")), 40, "0"))


def uid(number: Column) -> Column:
    return F.concat(F.lit("tpch:0x"), F.lpad((number % 25).cast("string"), 40, "0"))


def transfers(spark: SparkSession, sf_dir: str, narrow: bool = True) -> DataFrame:
    """lineitem and orders as a ledger of 25 assets, ordered within an asset by ``seq``: the month, and the place in it.

    Both tables are facts, so neither is broadcast, however small: the join is the same at every size. Orders, by their
    one key, are hashed within a partition, so neither table is sorted for it. What keys, flags and line numbers say is put in
    small numbers before the join, so rows that are moved for it hold little else. For ``seq`` the rows are moved as they are, which
    it orders by: with ``narrow`` false the numbers are made after the join.
    """
    open_, flag, line = F.col("l_linestatus") == "O", F.col("l_returnflag"), F.col("l_linenumber")
    yes = lambda c: F.when(c, 1).otherwise(0)
    numbers = [
        (F.col("l_partkey") % 25).alias("asset"), (F.col("l_suppkey") % 40).alias("sender"), F.when(line != 3, F.col("l_extendedprice")).alias("usd"),
        (yes(open_ & flag.isin("A", "N")) + 2 * yes(open_ & ((flag == "R") | (flag == "N") & (line == 7))) + 4 * yes(line % 2 == 0)).alias("kind"),
    ]
    rows = table(spark, sf_dir, "lineitem")
    buyers = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("recipient"))
    li = (rows.select(*ORDER, *numbers) if narrow else rows).join(buyers.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    li = li if narrow else li.select("*", *numbers)
    told = lambda bit: F.col("kind").bitwiseAND(F.lit(bit)) != 0
    sender = F.when(told(1), ZERO).otherwise(address(F.when(told(4), "A").otherwise("a"), F.col("sender")))
    to = F.when(told(2), DEAD).otherwise(address(F.lit("a"), F.col("recipient")))
    place = F.row_number().over(Window.partitionBy("asset", F.date_format("l_shipdate", "yyyy-MM")).orderBy(*ORDER))
    return li.select(
        uid(F.col("asset")).alias("asset_uid"), F.lit("ledger").alias("source"), F.col("l_shipdate").cast("timestamp").alias("block_time"),
        F.concat(F.lit("0x"), F.col("l_orderkey").cast("string")).alias("tx_hash"), F.col("l_linenumber").cast("long").alias("log_index"), sender.alias("from_address"), to.alias("to_address"),
        F.col("l_quantity").alias("amount"), F.col("usd").alias("amount_usd"),
        F.date_format("l_shipdate", "yyyy-MM").alias("bucket"), F.concat_ws("/", F.date_format("l_shipdate", "yyyy-MM"), F.lpad(place.cast("string"), 12, "0")).alias("seq"),
    )


def kept_transfers(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The transfers for queries that use them several times, joined (and with ``seq`` ordered) once: their columns for measures, and ``more``."""
    return settled(transfers(spark, sf_dir, "seq" not in more).select("asset_uid", "source", "block_time", "from_address", "to_address", "amount", "amount_usd", *more))


def lists(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Issuer and excluded addresses by asset."""
    assets = spark.range(25)
    tail = lambda x: F.concat(F.lit("0x"), F.lpad(F.lit(x), 40, "0"))
    issuers = assets.filter("id < 20").select(uid(F.col("id")).alias("asset_uid"), F.explode(F.array(tail("a7"), tail("a8"))).alias("address"))
    excluded = assets.filter("id % 2 = 0").select(uid(F.col("id")).alias("asset_uid"), tail("a3").alias("address")).union(
        assets.filter("id = 1").select(uid(F.col("id")).alias("asset_uid"), tail("a5").alias("address"))
    )
    return issuers, excluded


def classified(spark: SparkSession, sf_dir: str, t: DataFrame | None = None) -> DataFrame:
    return classify(transfers(spark, sf_dir) if t is None else t, lists(spark)[0])


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as snapshots of five sources; of one asset, source and moment the row of the least order key."""
    o = table(spark, sf_dir, "orders").select(uid(F.col("o_custkey")).alias("asset_uid"), F.col("o_orderpriority").alias("source"), F.col("o_orderdate").cast("timestamp").alias("as_of"), "*")
    r = o.groupBy("asset_uid", "source", "as_of").agg(F.min_by(F.struct("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), "o_orderkey").alias("r")).select("asset_uid", "source", "as_of", "r.*")
    return r.select(
        "asset_uid", "source", "as_of", F.concat(F.lit("P"), (F.col("o_custkey") % 25).cast("string")).alias("symbol"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("total_supply"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") * 2).alias("market_value_usd"),
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey")).alias("holder_count"),
    )


def month_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All months from the first to the last transfer, as a literal list: the two months are read once, whatever uses the list; none without transfers."""
    days = table(spark, sf_dir, "lineitem").agg(F.min("l_shipdate"), F.max("l_shipdate")).first()
    if days[0] is None:
        return windows.months(spark, "1970-01", "1970-01").filter("false")
    return windows.months(spark, f"{days[0]:%Y-%m}", f"{days[1]:%Y-%m}")


def balances(spark: SparkSession, sf_dir: str, t: DataFrame | None = None) -> DataFrame:
    """Balances just before every month's end."""
    return ledger.balances_at(transfers(spark, sf_dir) if t is None else t, month_list(spark, sf_dir).select(F.col("end").alias("as_of"), "month"))


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as undecoded logs: topics and hexadecimal numbers; one row in seven has a fourth topic, one in five no timestamp."""
    t = transfers(spark, sf_dir).withColumn("n", F.substring("tx_hash", 3, 20).cast("long") * 8 + F.col("log_index"))
    wide = lambda c: F.concat(F.lit("0x" + "0" * 24), F.substring(F.lower(c), 3, 40))
    hexed = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
    topics = F.array(F.lit(ledger.TRANSFER_TOPIC), wide("from_address"), wide("to_address"))
    return t.select(
        "asset_uid", F.when(F.col("n") % 7 == 0, F.concat(topics, F.array(F.lit("0x01")))).otherwise(topics).alias("topics"),
        F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(F.col("amount").cast("long"))), 64, "0")).alias("data"), hexed(F.substring("tx_hash", 3, 20).cast("long")).alias("blockNumber"),
        hexed("log_index").alias("logIndex"), F.col("tx_hash").alias("transactionHash"),
        F.when(F.col("n") % 5 != 0, hexed(F.unix_timestamp("block_time"))).alias("blockTimestamp"),
    )


_UID = "'tpch:0x' || lpad(CAST({0} % 25 AS VARCHAR), 40, '0')"
_PAD = "'0x' || lpad({0} || CAST({1} AS VARCHAR), 40, '0')"

#: The same views as common table expressions of DuckDB.
CTES = f"""
t AS (
  SELECT {_UID.format("l_partkey")} AS asset_uid, 'ledger' AS source, l_shipdate AS block_time, '0x' || l_orderkey AS tx_hash, CAST(l_linenumber AS BIGINT) AS log_index,
    CASE WHEN l_linestatus = 'O' AND l_returnflag IN ('A', 'N') THEN '{ZERO}'
      ELSE {_PAD.format("(CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'a' END)", "l_suppkey % 40")} END AS from_address,
    CASE WHEN l_linestatus = 'O' AND l_returnflag = 'R' THEN '{DEAD}' WHEN l_linestatus = 'O' AND l_returnflag = 'N' AND l_linenumber = 7 THEN '{DEAD}'
      ELSE {_PAD.format("'a'", "o_custkey % 40")} END AS to_address,
    l_quantity AS amount, CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS amount_usd, strftime(l_shipdate, '%Y-%m') AS window_id,
    row_number() OVER (PARTITION BY l_partkey % 25 ORDER BY {", ".join(ORDER)}) AS seq, l_orderkey, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
iss AS (SELECT {_UID.format("i")} AS asset_uid, '0x' || lpad(a, 40, '0') AS address FROM range(20) r(i), (VALUES ('a7'), ('a8')) v(a)),
exc AS (SELECT {_UID.format("i")} AS asset_uid, '0x' || lpad('a3', 40, '0') AS address FROM range(25) r(i) WHERE i % 2 = 0
  UNION ALL SELECT {_UID.format("1")}, '0x' || lpad('a5', 40, '0')),
k0 AS (SELECT t.*, lower(from_address) IN ('{ZERO}', '{DEAD}') AS fb, lower(to_address) IN ('{ZERO}', '{DEAD}') AS tb,
    EXISTS (SELECT 1 FROM iss i WHERE i.asset_uid = t.asset_uid AND i.address = lower(t.from_address)) AS fi,
    EXISTS (SELECT 1 FROM iss i WHERE i.asset_uid = t.asset_uid AND i.address = lower(t.to_address)) AS ti FROM t),
k AS (SELECT *, CASE WHEN fb AND tb THEN 'unclassified' WHEN fb OR fi THEN 'mint' WHEN tb OR ti THEN 'burn' ELSE 'secondary' END AS kind,
    CASE WHEN fb AND tb THEN 'unresolved' WHEN fb THEN 'creation' WHEN tb THEN 'destruction' WHEN fi OR ti THEN 'issuer_linked' ELSE 'residual' END AS category FROM k0),
w AS (SELECT strftime(m, '%Y-%m') AS window_id, m AS start, m + INTERVAL 1 MONTH AS "end" FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS m FROM (SELECT CAST(date_trunc('month', min(block_time)) AS TIMESTAMP) AS a, CAST(date_trunc('month', max(block_time)) AS TIMESTAMP) AS b FROM t))),
p AS (SELECT k.* FROM k JOIN w ON block_time >= start AND block_time < "end"),
s AS (SELECT asset_uid, source, as_of, 'P' || CAST(o_custkey % 25 AS VARCHAR) AS symbol, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS total_supply,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice * 2 END AS market_value_usd, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS holder_count
  FROM (SELECT {_UID.format("o_custkey")} AS asset_uid, o_orderpriority AS source, o_orderdate AS as_of, *,
      row_number() OVER (PARTITION BY o_custkey % 25, o_orderpriority, o_orderdate ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1),
leg AS (SELECT asset_uid, lower(from_address) AS address, -amount AS delta, block_time FROM t UNION ALL SELECT asset_uid, lower(to_address), amount, block_time FROM t),
b AS (SELECT asset_uid, w.window_id, w."end" AS as_of, address, sum(delta) AS balance FROM leg JOIN w ON block_time < w."end"
  WHERE address NOT IN ('{ZERO}', '{DEAD}') GROUP BY ALL HAVING sum(delta) > 0),
u AS (SELECT a.asset_uid, w.window_id, w.start, w."end" FROM (SELECT DISTINCT asset_uid FROM t) a, w)
"""
