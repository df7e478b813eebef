"""State lookups: the newest snapshot or holder list at the end of a window, and the denominator of shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.schemas import HOLDER_LIST_FLOOR, SHARE_CEILING, SNAPSHOT_GRACE_HOURS

FIELDS = ("symbol", "name", "decimals", "total_supply", "market_value_usd", "price_usd", "holder_count")


def _reach(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows with the windows they may describe: as_of up to an hour after the end. The window list is broadcast."""
    w = F.broadcast(windows.select("window_id", "end"))
    return rows.join(w, F.col("as_of") <= F.col("end") + F.expr(f"interval {SNAPSHOT_GRACE_HOURS} hours"))


def latest_snapshot(snapshots: DataFrame, windows: DataFrame, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Per asset and window, each field's newest value that is not null; ties go to the greatest source name.

    Snapshots are first reduced to the newest value of each window's own interval, so a row is not copied to every
    later window; the windows then look back over these.
    """
    have = fields or tuple(f for f in FIELDS if f in snapshots.columns)
    ends = windows.select("end").distinct().agg(F.sort_array(F.collect_list("end")).alias("__ends"))
    grace = F.expr(f"interval {SNAPSHOT_GRACE_HOURS} hours")
    placed = snapshots.crossJoin(F.broadcast(ends)).withColumn("end", F.get(F.filter("__ends", lambda e: F.col("as_of") <= e + grace), F.lit(0))).filter("end IS NOT NULL")
    newest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("as_of", "source", F.col(c).alias("v")))).alias(c)
    cells = placed.groupBy("asset_uid", "end").agg(*[newest(c) for c in have])
    grid = cells.select("asset_uid").distinct().crossJoin(F.broadcast(windows.select("window_id", "end")))
    w = Window.partitionBy("asset_uid").orderBy("end").rowsBetween(Window.unboundedPreceding, 0)
    out = grid.join(cells, ["asset_uid", "end"], "left").select("asset_uid", "window_id", *[F.max(c).over(w).getField("v").alias(c) for c in have], F.max(F.greatest(*[F.col(c)["as_of"] for c in have]) if len(have) > 1 else F.col(have[0])["as_of"]).over(w).alias("newest"))
    return out.filter("newest IS NOT NULL").drop("newest")


def latest_holders(holders: DataFrame, windows: DataFrame) -> DataFrame:
    """All rows of each asset's newest as_of that a window reaches; every source's rows of that moment are kept."""
    moments = _reach(holders.select("asset_uid", "as_of").distinct(), windows).groupBy("asset_uid", "window_id").agg(F.max("as_of").alias("as_of"))
    return holders.join(moments, ["asset_uid", "as_of"])


def exact_state(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows whose as_of is exactly a window's end."""
    return rows.join(F.broadcast(windows.select("window_id", F.col("end").alias("as_of"))), "as_of")


def share_denominator(reported: DataFrame, observed: DataFrame) -> DataFrame:
    """From (asset_uid, window_id, total_supply, holder_count) and (asset_uid, window_id, observed, listed): denominator, error_code and warnings.

    The reported supply, else the observed sum with a warning; a supply of zero or less is an error; a list of fewer than
    99 % of the reported holders and an observed sum above the supply warn.
    """
    j = observed.join(reported, ["asset_uid", "window_id"], "left")
    supply = F.coalesce("total_supply", "observed")
    warnings = F.array_compact(
        F.array(
            F.when(F.col("total_supply").isNull(), F.lit("supply_from_holders")),
            F.when(F.col("listed") < HOLDER_LIST_FLOOR * F.col("holder_count"), F.lit("truncated_holder_list")),
            F.when(F.col("observed") > F.col("total_supply") * SHARE_CEILING, F.lit("holders_exceed_supply")),
        )
    )
    return j.withColumn("error_code", F.when(supply <= 0, "supply_not_positive")).withColumn("denominator", F.when(supply > 0, supply)).withColumn("warnings", warnings)


def first_symbol(snapshots: DataFrame) -> DataFrame:
    """The earliest symbol of an asset that is not empty."""
    named = snapshots.filter(F.length("symbol") > 0)
    return named.groupBy("asset_uid").agg(F.min(F.struct("as_of", "source", "symbol"))["symbol"].alias("symbol"))
