"""Landed provider responses to normalized rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.classify import classify
from ledgerscope.functions.keys import asset_uid, contract_text, hex_to_decimal, hex_to_long, parse_utc
from ledgerscope.schemas import Table
from ledgerscope.shared import settled

ROWS = "struct<state:string,result:struct<rows:array<map<string,string>>>,next_offset:bigint>"


class ContractError(ValueError):
    """A payload does not have what its job needs."""


def saved_query_rows(responses: DataFrame, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> DataFrame:
    """Rows of finished saved-query pages as text columns; optional columns that are absent are typed nulls.

    An unfinished query and a row without a required column fail, with what is wrong, by a one-row aggregate. Pages are
    read and parsed once; their rows are written for the checks and for what follows.
    """
    page = responses.select(F.from_json("body", ROWS).alias("p"))
    unfinished = (F.coalesce(F.col("p.state"), F.lit("")) != "QUERY_STATE_COMPLETED").alias("__unfinished")
    # a page without rows keeps one, so that its state is seen
    rows = page.select(unfinished, F.posexplode_outer("p.result.rows").alias("__at", "r"))
    lacks = [(F.col("__at").isNotNull() & ~F.map_contains_key("r", c)).alias(f"__lacks_{c}") for c in required]
    columns = [F.try_element_at("r", F.lit(c)).alias(c) for c in (*required, *optional)]
    rows = settled(rows.select("__unfinished", "__at", *lacks, *columns))
    found = rows.agg(F.count_if(F.col("__unfinished") & (F.coalesce("__at", F.lit(0)) == 0)).alias("states"), *[F.count_if(f"__lacks_{c}").alias(c) for c in required]).collect()[0]
    if found["states"]:
        raise ContractError(f"{found['states']} pages of an unfinished query")
    if bad := [c for c in required if found[c]]:
        raise ContractError(f"missing columns: {', '.join(bad)}")
    return rows.filter("__at IS NOT NULL").select(*required, *optional)


def scoped(rows: DataFrame, assets: DataFrame, start: Column | None = None, end: Column | None = None, time: str = "block_time") -> DataFrame:
    """Rows of the wanted assets, and of the times start <= time < end where bounds are given."""
    out = rows.join(assets.select("asset_uid").distinct(), "asset_uid", "left_semi")
    if start is not None:
        out = out.filter(F.col(time) >= start)
    return out.filter(F.col(time) < end) if end is not None else out


def completed(rows: DataFrame, table: Table, source: str, retrieved_at: Column, as_of: Column | None = None, issuers: DataFrame | None = None) -> DataFrame:
    """A job's rows with the columns and types of their declared table, so that ``validate`` takes them.

    The envelope is added; snapshots and holders without an ``as_of`` get the given one, else the time of retrieval;
    transfers get their kind from the issuers; columns that the job does not give are typed nulls.
    """
    out = rows.withColumn("source", F.lit(source)).withColumn("retrieved_at", retrieved_at)
    if "as_of" in table.schema.names and "as_of" not in out.columns:
        out = out.withColumn("as_of", as_of if as_of is not None else F.col("retrieved_at"))
    if "kind" in table.schema.names and issuers is not None:
        out = classify(out, issuers)
    return out.select(*[(F.col(f.name) if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema])


def unparsed_times(rows: DataFrame, column: str) -> tuple[int, list[str]]:
    """How many timestamps fit no format, and up to three of them."""
    bad = rows.filter(F.col(column).isNotNull() & parse_utc(F.col(column)).isNull())
    return bad.count(), [r[0] for r in bad.select(column).limit(3).collect()]


def saved_query_transfers(responses: DataFrame, chain: str) -> DataFrame:
    rows = saved_query_rows(responses, ("block_time", "tx_hash", "log_index", "contract_address", "from_address", "to_address", "amount"), ("amount_usd",))
    n, few = unparsed_times(rows, "block_time")
    if n:
        raise ContractError(f"{n} timestamps fit no format, such as {', '.join(few)}")
    return rows.select(
        asset_uid(F.lit(chain), F.col("contract_address")).alias("asset_uid"), parse_utc(F.col("block_time")).alias("block_time"), "tx_hash",
        F.col("log_index").cast("long").alias("log_index"), F.lower("from_address").alias("from_address"), F.lower("to_address").alias("to_address"),
        F.col("amount").cast("double").alias("amount"), F.col("amount_usd").cast("double").alias("amount_usd"),
    )


def saved_query_holders(responses: DataFrame, chain: str, retrieved_at: Column) -> DataFrame:
    rows = saved_query_rows(responses, ("contract_address", "address", "balance"), ("balance_usd", "as_of"))
    return rows.select(
        asset_uid(F.lit(chain), F.col("contract_address")).alias("asset_uid"), F.coalesce(parse_utc(F.col("as_of")), retrieved_at).alias("as_of"),
        F.lower("address").alias("address"), F.col("balance").cast("double").alias("balance"), F.col("balance_usd").cast("double").alias("balance_usd"),
    )


def prices(responses: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``coins`` maps to snapshots, and the wanted assets that no response has. A repeated asset collapses to its newest price."""
    coin = "struct<coins:map<string,struct<price:double,symbol:string,decimals:int,timestamp:bigint>>>"
    rows = responses.select(F.explode(F.from_json("body", coin)["coins"]).alias("asset_uid", "c"))
    found = rows.groupBy("asset_uid").agg(F.max_by("c", F.col("c.timestamp")).alias("c")).select(
        "asset_uid", F.timestamp_seconds("c.timestamp").alias("as_of"), "c.symbol", "c.decimals", F.col("c.price").alias("price_usd")
    )
    want = wanted.select("asset_uid").distinct()
    return found.join(want, "asset_uid", "left_semi"), want.join(found, "asset_uid", "left_anti")


def protocol_series(responses: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last point of each asset's own chain's series, and the assets rejected for lack of one. Responses have (slug, body), assets (asset_uid, slug, chain)."""
    shape = "struct<chainTvls:map<string,struct<tvl:array<struct<date:bigint,totalLiquidityUSD:double>>>>>"
    series = responses.select("slug", F.from_json("body", shape)["chainTvls"].alias("t"))
    j = assets.join(series, "slug", "left").withColumn("p", F.try_element_at(F.try_element_at("t", F.col("chain"))["tvl"], F.lit(-1)))
    good = F.col("p.date").isNotNull() & F.col("p.totalLiquidityUSD").isNotNull()
    found = j.filter(good).select("asset_uid", F.timestamp_seconds("p.date").alias("as_of"), F.col("p.totalLiquidityUSD").alias("market_value_usd"))
    return found, j.filter(F.coalesce(~good, F.lit(True))).select("asset_uid", "slug", "chain")


def token_list(responses: DataFrame, wanted: DataFrame, aliases: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Pages (page, body) of tokens to snapshots, the first row of an asset kept; and the wanted assets not listed."""
    metric = "struct<val:double>"
    shape = f"struct<results:array<struct<network:string,address:string,symbol:string,name:string,price:{metric},market_value:{metric},supply:{metric},holders:struct<val:bigint>>>>"
    rows = responses.select("page", F.posexplode(F.from_json("body", shape)["results"]).alias("at", "r"))
    chain = F.regexp_replace(F.lower(F.trim("r.network")), r"\s+", "-")
    for name, other in aliases.items():
        chain = F.when(chain == name, other).otherwise(chain)
    rows = rows.withColumn("asset_uid", asset_uid(chain, F.col("r.address"))).filter("asset_uid IS NOT NULL")
    first = rows.groupBy("asset_uid").agg(F.min_by("r", F.struct("page", "at")).alias("r"))
    found = first.select(
        "asset_uid", "r.symbol", "r.name", F.col("r.supply.val").alias("total_supply"), F.col("r.market_value.val").alias("market_value_usd"),
        F.col("r.price.val").alias("price_usd"), F.col("r.holders.val").alias("holder_count"),
    )
    want = wanted.select("asset_uid").distinct()
    return found.join(want, "asset_uid", "left_semi"), want.join(found, "asset_uid", "left_anti")


#: Function selectors of token contracts.
SELECTORS = {"decimals": "0x313ce567", "totalSupply": "0x18160ddd", "symbol": "0x95d89b41", "name": "0x06fdde03"}


def contract_snapshots(calls: DataFrame) -> DataFrame:
    """calls (asset_uid, selector, block, result) to snapshots; ``error_code`` is set where decimals are missing or above 255, a byte's largest. Prices are null."""
    pick = lambda name: F.max(F.when(F.col("selector") == SELECTORS[name], F.col("result")))
    one = calls.groupBy("asset_uid", "block").agg(*[pick(n).alias(n) for n in SELECTORS])
    read = hex_to_long(F.col("decimals"))
    decimals = F.when(read <= 255, read.cast("int"))
    supply = hex_to_decimal(F.col("totalSupply")).cast("double") / F.pow(F.lit(10.0), decimals)
    return one.select(
        "asset_uid", "block", contract_text(F.col("symbol")).alias("symbol"), contract_text(F.col("name")).alias("name"), decimals.alias("decimals"),
        supply.alias("total_supply"), F.lit(None).cast("double").alias("price_usd"), F.when(decimals.isNull(), "no_decimals").alias("error_code"),
    )
