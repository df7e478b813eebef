"""The measures of all assets in all windows, every mode and denomination from one pass. An undefined value is null, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.classify import is_burn
from ledgerscope.schemas import BURN, DENOMINATIONS, HHI_SCALE, MODES, SHARE_CEILING, TOP_N

KEY = ["asset_uid", "window_id"]


def _modes() -> Column:
    """The modes that count a transfer of this kind."""
    return F.array_compact(F.array(*[F.when(F.col("kind").isin(*kinds), F.lit(mode)) for mode, kinds in MODES.items()]))


def volumes(placed: DataFrame, universe: DataFrame) -> DataFrame:
    """Per asset, window and mode: n, native and usd volume, nulls among them. ``universe`` (asset_uid, window_id) are the measured pairs.

    Nothing counted is 0.0; if every counted amount is null the volume is null.
    """
    aggs = [F.count("*").alias("n")]
    for name, (amount, _) in DENOMINATIONS.items():
        aggs += [F.sum(amount).alias(f"sum_{name}"), F.count(amount).alias(f"count_{name}")]
    found = placed.withColumn("mode", F.explode(_modes())).groupBy(*KEY, "mode").agg(*aggs)
    grid = universe.select(*KEY).withColumn("mode", F.explode(F.array(*[F.lit(m) for m in MODES])))
    out = grid.join(found, [*KEY, "mode"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    for name in DENOMINATIONS:
        out = out.withColumn(f"volume_{name}", F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col(f"sum_{name}").cast("double")))
        out = out.withColumn(f"nulls_{name}", F.col("n") - F.coalesce(f"count_{name}", F.lit(0)))
    return out.select(*KEY, "mode", "n", *[f"{x}_{d}" for d in DENOMINATIONS for x in ("volume", "nulls")])


def unclassified_share(placed: DataFrame) -> DataFrame:
    """Transfers that narrow modes set aside, and their share."""
    return placed.groupBy(*KEY).agg(F.count_if(F.col("kind") == "unclassified").alias("n_unclassified"), F.avg((F.col("kind") == "unclassified").cast("int")).alias("share_unclassified"))


def turnover(volume: DataFrame, state: DataFrame) -> DataFrame:
    """Volume over supply (native) or market value (usd) at the end; null if the size is missing or not positive."""
    out = volume.join(state.select(*KEY, *[size for _, size in DENOMINATIONS.values()]), KEY, "left")
    for name, (_, size) in DENOMINATIONS.items():
        out = out.withColumn(f"turnover_{name}", F.when(F.col(size) > 0, F.col(f"volume_{name}") / F.col(size)))
    return out


def active(placed: DataFrame) -> DataFrame:
    """Distinct (asset_uid, window_id, mode, address) of either side, burn addresses left out, in lower case."""
    sides = F.explode(F.array(F.lower("from_address"), F.lower("to_address")))
    rows = placed.select(*KEY, F.explode(_modes()).alias("mode"), "from_address", "to_address").select(*KEY, "mode", sides.alias("address"))
    return rows.filter(~F.col("address").isin(*BURN)).distinct()


def active_counts(active_rows: DataFrame) -> DataFrame:
    """Counted after the distinct rows are dealt by address, so a busy asset is no hot key."""
    return active_rows.groupBy(*KEY, "mode").agg(F.count("*").alias("active_addresses"))


def volume_per_active(volume: DataFrame, counts: DataFrame) -> DataFrame:
    out = volume.join(counts, [*KEY, "mode"], "left")
    return out.withColumn("volume_per_active", F.when(F.col("active_addresses") > 0, F.col("volume_native") / F.col("active_addresses")))


def active_holder_ratio(counts: DataFrame, listed: DataFrame) -> DataFrame:
    """Active addresses over observed holders (all rows of the list), else over the reported count. Above 1 it is kept."""
    base = F.coalesce(F.when(F.col("listed") > 0, F.col("listed")), F.col("holder_count"))
    return listed.join(counts, KEY, "left").withColumn("active_holder_ratio", F.when(base > 0, F.coalesce("active_addresses", F.lit(0)) / base))


def prepare_holders(holders: DataFrame, excluded: DataFrame) -> DataFrame:
    """Adds ``retained``: neither a burn address nor on the asset's list of excluded ones. Burn addresses themselves are dropped."""
    lists = excluded.select("asset_uid", F.lower("address").alias("__a")).distinct().withColumn("__x", F.lit(True))
    out = holders.filter(~is_burn(F.col("address"))).withColumn("__a", F.lower("address")).join(lists, ["asset_uid", "__a"], "left")
    return out.withColumn("retained", F.col("__x").isNull()).drop("__a", "__x")


def guarded(value: Column) -> Column:
    """A share above one (but for rounding) is impossible and becomes null."""
    return F.when(value <= SHARE_CEILING, value)


def concentration(holders: DataFrame, supply: DataFrame | None = None, top_n: int = TOP_N) -> DataFrame:
    """Holders with ``retained`` and (asset_uid, window_id, denominator) to top-n share, HHI, coverage and the conditional forms.

    Without a supply the denominator is the sum of all prepared holders, taken in the same aggregate.

    Shares of all prepared holders are of the supply; conditional ones are of the retained sum. Top-n ranks keep n rows a
    task before the shuffle.
    """
    if top_n <= 0:
        raise ValueError("top_n must be positive")
    kept, own = holders.filter("retained"), F.when(F.col("retained"), F.col("balance"))
    sums = holders.groupBy(*KEY).agg(
        F.sum(own).alias("b"), F.sum(own * own).alias("bb"), F.nullif(F.count(own), F.lit(0)).alias("retained_holders"), F.sum("balance").alias("__all")
    )
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("balance"), "address"))
    top = kept.withColumn("__r", rank).filter(F.col("__r") <= top_n).groupBy(*KEY).agg(F.sum("balance").alias("top"))
    s = F.col("denominator")
    base = sums.withColumnRenamed("__all", "denominator") if supply is None else supply.select(*KEY, "denominator").join(sums.drop("__all"), KEY, "left")
    out = base.join(top, KEY, "left")
    return out.select(
        *KEY, "denominator", "retained_holders",
        guarded(F.col("top") / s).alias("top_share"),
        (guarded(F.col("bb") / (s * s)) * HHI_SCALE).alias("hhi"),
        guarded(F.col("b") / s).alias("coverage"),
        F.when(F.col("b") > 0, F.col("bb") / (F.col("b") * F.col("b")) * HHI_SCALE).alias("conditional_hhi"),
        F.when(F.col("b") > 0, F.col("top") / F.col("b")).alias("conditional_top_share"),
        F.lit(top_n).alias("top_n"),
        F.array_compact(F.array(F.when(F.col("retained_holders") < top_n, F.lit("fewer_holders_than_top_n")), F.when(F.col("b") > s * SHARE_CEILING, F.lit("impossible_share")))).alias("warnings"),
    )


def dormancy(holders: DataFrame, active_rows: DataFrame, supply: DataFrame) -> DataFrame:
    """The share of the supply held by addresses that were not active in the window: a left join with the active ones, safe with nulls.

    Null, not zero, where no holder is left. ``holders`` are those that are left after exclusions.
    """
    live = active_rows.select(*KEY, "address").withColumn("__live", F.lit(True))
    marked = holders.withColumn("address", F.lower("address")).join(live, [*KEY, "address"], "left")
    sums = marked.groupBy(*KEY).agg(F.sum(F.when(F.col("__live").isNull(), F.col("balance")).otherwise(0)).alias("idle"))
    return supply.join(sums, KEY, "left").select(*KEY, guarded(F.col("idle") / F.col("denominator")).alias("dormancy"))


def provenance(metric: str, mode: str | None, denomination: str | None, sources: Column, records: Column, exclusions: Column, warnings: Column) -> Column:
    """Where a value comes from, as one struct; sentences are rendered from the codes elsewhere."""
    text = lambda x: F.lit(x).cast("string")
    return F.struct(
        F.lit(metric).alias("metric"), F.col("asset_uid"), F.col("window_id"), sources.alias("sources"), records.alias("n_records"),
        text(mode).alias("mode"), text(denomination).alias("denomination"), exclusions.alias("exclusions"), warnings.alias("warnings"),
    )
