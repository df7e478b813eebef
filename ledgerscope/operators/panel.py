"""The monthly panel: activity by category, participation, and ownership with its coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.classify import is_burn, participates
from ledgerscope.operators.windows import assign
from ledgerscope.schemas import CATEGORIES, HHI_SCALE, RETAINED_COVERAGE_FLOOR, TOP_N

KEY = ["asset_uid", "window_id"]


def skeleton(assets: DataFrame, windows: DataFrame) -> DataFrame:
    """Every asset in every window; unmeasured ones too."""
    return assets.select("asset_uid").distinct().crossJoin(F.broadcast(windows.select("window_id", "start", "end")))


def activity(placed: DataFrame, grid: DataFrame, supply: DataFrame) -> DataFrame:
    """Counts and volumes by category, totals, turnover of all and of residual transfers, f and x. f needs residual volume, x any."""
    aggs = [a for c in CATEGORIES for a in (F.count_if(F.col("category") == c).alias(f"n_{c}"), F.sum(F.when(F.col("category") == c, F.col("amount"))).alias(f"v_{c}"))]
    out = grid.select(*KEY).join(placed.groupBy(*KEY).agg(*aggs), KEY, "left").join(supply.select(*KEY, "total_supply"), KEY, "left")
    names = [f"{x}_{c}" for c in CATEGORIES for x in ("n", "v")]
    out = out.fillna(0, names)
    out = out.withColumn("n_all", sum((F.col(f"n_{c}") for c in CATEGORIES[1:]), F.col(f"n_{CATEGORIES[0]}")))
    out = out.withColumn("v_all", sum((F.col(f"v_{c}") for c in CATEGORIES[1:]), F.col(f"v_{CATEGORIES[0]}")))
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.select(
        *KEY, *names, "n_all", "v_all", per("v_all", "total_supply").alias("t_all"), per("v_residual", "total_supply").alias("t_res"),
        per("v_all", "v_residual").alias("f"), F.when(F.col("v_all") > 0, 1 - F.col("v_residual") / F.col("v_all")).alias("x"),
    )


def participants(placed: DataFrame) -> DataFrame:
    """Distinct parties of residual transfers between two addresses, burn addresses left out."""
    side = F.explode(F.array(F.lower("from_address"), F.lower("to_address"))).alias("address")
    return placed.filter(participates()).select(*KEY, side).filter(~is_burn(F.col("address"))).distinct()


def ownership(holders: DataFrame, taking_part: DataFrame, supply: DataFrame, excluded: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """Holders at exact window ends to participation, dormancy, coverage and concentration. Nothing without a positive supply or after a failed reconciliation."""
    lists = excluded.select("asset_uid", F.lower("address").alias("address")).distinct().withColumn("__x", F.lit(True))
    h = holders.groupBy(*KEY, F.lower("address").alias("address")).agg(F.max("balance").alias("balance"))
    h = h.join(lists, ["asset_uid", "address"], "left").join(taking_part.withColumn("__p", F.lit(True)), [*KEY, "address"], "left")
    h = h.withColumn("retained", F.col("__x").isNull()).withColumn("takes_part", F.col("__p").isNotNull())
    rank = lambda first: F.row_number().over(Window.partitionBy(*KEY).orderBy(*first, F.desc("balance"), "address"))
    h = h.withColumn("r_all", rank([])).withColumn("r_ret", rank([F.desc("retained")]))
    b, kept = F.col("balance"), F.col("retained")
    s = h.groupBy(*KEY).agg(
        F.count("*").alias("holders"), F.count_if(kept).alias("retained_holders"), F.avg(F.col("takes_part").cast("int")).alias("participation"),
        F.sum(F.when(~F.col("takes_part"), b).otherwise(0)).alias("idle"), F.sum(b * b).alias("bb"), F.sum(F.when(kept, b).otherwise(0)).alias("rb"),
        F.sum(F.when(kept, b * b).otherwise(0)).alias("rbb"), F.sum(F.when(F.col("r_all") <= TOP_N, b)).alias("top"),
        F.coalesce(F.sum(F.when(kept & (F.col("r_ret") <= TOP_N), b)), F.lit(0)).alias("rtop"),
    )
    s = s.join(supply.select(*KEY, "total_supply"), KEY).filter(F.col("total_supply") > 0)
    if status is not None:
        s = s.join(status.filter("reconciled = false").select("asset_uid"), "asset_uid", "left_anti")
    z = F.col("total_supply")
    out = s.withColumn("coverage", F.col("rb") / z).withColumn("assessable", F.col("coverage") >= RETAINED_COVERAGE_FLOOR)
    return out.select(
        *KEY, "holders", "retained_holders", "participation", (F.col("idle") / z).alias("dormancy"), (F.col("bb") / (z * z) * HHI_SCALE).alias("h_all"),
        "coverage", (F.col("rbb") / (z * z) * HHI_SCALE).alias("h_ret"),
        F.when(F.col("assessable"), F.col("rbb") / (F.col("rb") * F.col("rb")) * HHI_SCALE).alias("h_cond"),
        (F.col("top") / z).alias("k_all"), (F.col("rtop") / z).alias("k_ret"), F.when(F.col("assessable"), F.col("rtop") / F.col("rb")).alias("k_cond"), "assessable",
    )


def build_panel(assets: DataFrame, windows: DataFrame, transfers: DataFrame, holders: DataFrame, supply: DataFrame, excluded: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """The panel of categorized transfers, holder balances and supply at window ends. Assets without transfers keep their rows."""
    grid = skeleton(assets, windows)
    placed = assign(transfers, windows)
    ends = F.broadcast(windows.select("window_id", F.col("end").alias("as_of")))
    # several sources at one moment: the least source name answers
    at_end = supply.join(ends, "as_of").groupBy(*KEY).agg(F.min(F.struct(*[c for c in ("source",) if c in supply.columns], "total_supply"))["total_supply"].alias("total_supply"))
    owned = ownership(holders.join(ends, "as_of"), participants(placed), at_end, excluded, status)
    return grid.join(activity(placed, grid, at_end), KEY).join(at_end, KEY, "left").join(owned, KEY, "left")


def month_summary(panel: DataFrame) -> DataFrame:
    """Per asset: months with volume; median, least and most of x and f over the months where they are defined."""
    spread = [a for c in ("x", "f") for a in (F.median(c).alias(f"{c}_median"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))]
    return panel.groupBy("asset_uid").agg(F.count_if(F.col("v_all") > 0).alias("months_with_volume"), *spread)


def selected(panel: DataFrame, assets: list[str], window_id: str) -> DataFrame:
    """The given assets in the given order for one window; absent ones are rows of nulls."""
    want = panel.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(a) for a in assets])).alias("position", "asset_uid"))
    return F.broadcast(want).join(panel.filter(F.col("window_id") == window_id), "asset_uid", "left")


def figures(panel: DataFrame, asset: str, factor: str | None = None, names: tuple[str, ...] = ("coverage", "h_all", "h_ret", "h_cond", "k_all", "k_ret", "k_cond")) -> DataFrame:
    """Ownership figures of one asset in its first and last window, and median, least and most of another's factor f over the months, as (place, name, value)."""
    rows = panel.filter(F.col("asset_uid") == asset)
    edge = rows.agg(F.min("window_id").alias("first"), F.max("window_id").alias("last"))
    at = rows.join(F.broadcast(edge), (F.col("window_id") == F.col("first")) | (F.col("window_id") == F.col("last")))
    at = at.withColumn("place", F.when(F.col("window_id") == F.col("first"), "first").otherwise("last"))
    out = at.select("place", *[F.col(n).cast("double") for n in names]).unpivot(["place"], list(names), "name", "value")
    if factor is None:
        return out
    spread = panel.filter(F.col("asset_uid") == factor).agg(*[g("f").cast("double").alias(n) for n, g in (("f_median", F.median), ("f_min", F.min), ("f_max", F.max))])
    return out.unionByName(spread.select(F.lit("months").alias("place"), "*").unpivot(["place"], ["f_median", "f_min", "f_max"], "name", "value"))


def span(panel: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """First start, last end and number of windows of a panel; with ``blocks`` (number, timestamp) the head block, and the first block of the last window."""
    out = panel.agg(F.min("start").alias("first_start"), F.max("end").alias("last_end"), F.max("start").alias("__last"), F.count_distinct("window_id").alias("windows"))
    if blocks is not None:
        heads = blocks.crossJoin(F.broadcast(out.select("__last", "last_end"))).agg(
            F.max("number").alias("head_block"), F.min(F.when((F.col("timestamp") >= F.col("__last")) & (F.col("timestamp") < F.col("last_end")), F.col("number"))).alias("last_window_block")
        )
        out = out.crossJoin(F.broadcast(heads))
    return out.drop("__last")
