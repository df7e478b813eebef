"""Report and trend over all assets and windows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.operators import asof, measures
from ledgerscope.operators.windows import assign
from ledgerscope.schemas import MATERIAL_CHANGE
from ledgerscope.shared import settled

KEY = measures.KEY
#: What a ledger that fails reconciliation makes unusable.
HOLDER_MEASURES = ("active_holder_ratio", "dormancy", "top_share", "hhi", "coverage", "conditional_hhi", "conditional_top_share")
MEASURES = ("turnover", "volume_per_active", *HOLDER_MEASURES)


@dataclass(frozen=True)
class Inputs:
    """Classified transfers, holders, snapshots, excluded addresses, and optionally (asset_uid, missing_kinds, reconciliation_checked, reconciled)."""

    transfers: DataFrame
    holders: DataFrame
    snapshots: DataFrame
    excluded: DataFrame
    status: DataFrame | None = None


def build_report(inputs: Inputs, windows: DataFrame, mode: str = "secondary_only", denomination: str = "native", top_n: int = 10) -> DataFrame:
    """One row per asset and window with the nine measures, n_transfers, quality columns and warning codes.

    The assets are those of the snapshots and those with a status row; each keeps a row. Kinds of data that are missing
    null the measures; a failed reconciliation nulls those of holders; one that was tried without an answer warns.
    """
    assets = inputs.snapshots.select("asset_uid").distinct()
    if inputs.status is not None:
        assets = assets.unionByName(inputs.status.select("asset_uid")).distinct()
    universe = assets.crossJoin(F.broadcast(windows.select("window_id")))
    placed = assign(inputs.transfers, windows)
    volume = measures.volumes(placed, universe).filter(F.col("mode") == mode)
    state = asof.latest_snapshot(inputs.snapshots, windows)
    turned = measures.turnover(volume, state).withColumnRenamed(f"turnover_{denomination}", "turnover")
    active = measures.active(placed).filter(F.col("mode") == mode)
    counts = measures.active_counts(active)
    held = asof.latest_holders(inputs.holders, windows)
    listed = held.groupBy(*KEY).agg(F.count("*").alias("listed"))  # burn addresses too
    prepared = settled(measures.prepare_holders(held, inputs.excluded))  # four uses
    kept = prepared.filter("retained")
    # shares are of the holders that are left: their sum where no supply is reported, their number against the reported one
    observed = listed.select(*KEY).join(kept.groupBy(*KEY).agg(F.sum("balance").alias("observed"), F.count("*").alias("listed")), KEY, "left").fillna(0, ["observed", "listed"])
    supply = asof.share_denominator(state.select(*KEY, "total_supply", "holder_count"), observed)
    spread = measures.concentration(prepared, supply, top_n).withColumnRenamed("warnings", "spread_warnings").drop("denominator")
    idle = measures.dormancy(kept, active, supply)
    ratio = measures.active_holder_ratio(counts, universe.join(listed, KEY, "left").join(state.select(*KEY, "holder_count"), KEY, "left")).select(*KEY, "active_holder_ratio")
    blocks = [
        turned.select(*KEY, F.col("n").alias("n_transfers"), "turnover", F.col(f"nulls_{denomination}").alias("null_amounts")),
        measures.volume_per_active(volume, counts).select(*KEY, "active_addresses", "volume_per_active"),
        ratio, idle, spread, supply.select(*KEY, "error_code", F.col("warnings").alias("supply_warnings")),
    ]
    out = reduce(lambda a, b: a.join(b, KEY, "left"), blocks, universe)
    out = out.join(asof.first_symbol(inputs.snapshots), "asset_uid", "left")
    return gate(out, inputs.status).withColumn("mode", F.lit(mode)).withColumn("denomination", F.lit(denomination))


def gate(report: DataFrame, status: DataFrame | None) -> DataFrame:
    """Unmeasured, withheld and unverified: three answers, kept apart."""
    if status is None:
        empty = F.array().cast("array<string>")
        status = report.select("asset_uid").distinct().select("asset_uid", empty.alias("missing_kinds"), F.lit(False).alias("reconciliation_checked"), F.lit(None).cast("boolean").alias("reconciled"))
    out = report.join(status, "asset_uid", "left")
    unmeasured = F.size(F.coalesce("missing_kinds", F.array().cast("array<string>"))) > 0
    withheld = F.coalesce(~F.col("reconciled"), F.lit(False))
    for m in MEASURES:
        bad = unmeasured | withheld if m in HOLDER_MEASURES else unmeasured
        out = out.withColumn(m, F.when(~bad, F.col(m)))
    own = F.array_compact(
        F.array(
            F.when(unmeasured, F.concat(F.lit("missing:"), F.array_join("missing_kinds", ","))),
            F.when(withheld, F.lit("withheld")),
            F.when(F.coalesce("reconciliation_checked", F.lit(False)) & F.col("reconciled").isNull(), F.lit("unverified")),
            F.when(F.col("null_amounts") > 0, F.lit("null_amounts")),
            F.col("error_code"),
        )
    )
    none = F.array().cast("array<string>")
    codes = F.array_distinct(F.concat(own, F.coalesce("supply_warnings", none), F.coalesce("spread_warnings", none)))
    return out.withColumn("warnings", codes).withColumn("n_warnings", F.size(codes)).drop("supply_warnings", "spread_warnings")


def export_rows(report: DataFrame, sources: DataFrame, windows: DataFrame, blocks: DataFrame | None = None, dropped: DataFrame | None = None) -> DataFrame:
    """The flattened form: window bounds, block columns, source list and warnings as text, in order of asset and window.

    ``sources`` is (asset_uid, sources array); ``blocks`` (window_id, first_block, last_block, head_block) and ``dropped``
    (asset_uid, dropped) are null where the data did not come from a ledger.
    """
    out = report.join(sources, "asset_uid", "left").withColumn("sources", F.concat_ws(", ", "sources")).withColumn("warnings", F.concat_ws("; ", "warnings"))
    out = out.join(F.broadcast(windows.select("window_id", F.col("start").alias("window_start"), F.col("end").alias("window_end"))), "window_id", "left")
    none = lambda *names: [F.lit(None).cast("long").alias(n) for n in names]
    out = out.join(F.broadcast(blocks), "window_id", "left") if blocks is not None else out.select("*", *none("first_block", "last_block", "head_block"))
    out = out.join(dropped.select("asset_uid", F.col("dropped").alias("dropped_transfers")), "asset_uid", "left") if dropped is not None else out.select("*", *none("dropped_transfers"))
    return out.select(
        "asset_uid", "symbol", "window_id", "window_start", "window_end", F.col("first_block").alias("start_block"), F.col("last_block").alias("end_block"), "head_block",
        "mode", "denomination", "n_transfers", *MEASURES, "top_n", "reconciled", "dropped_transfers", "sources", "n_warnings", "warnings",
    ).orderBy("asset_uid", "window_id")


def build_trend(report: DataFrame, windows: DataFrame, metrics: tuple[str, ...] = MEASURES) -> DataFrame:
    """Long form, one row per asset, metric and window, with the direction of the metric over the windows."""
    long = report.select("asset_uid", "window_id", *[F.col(m).cast("double") for m in metrics]).unpivot(["asset_uid", "window_id"], list(metrics), "metric", "value")
    long = long.join(F.broadcast(windows.select("window_id", "start")), "window_id")
    return long.join(direction(long), ["asset_uid", "metric"]).select("asset_uid", "metric", "window_id", "value", "direction")


def direction(long: DataFrame) -> DataFrame:
    """From (asset_uid, metric, start, value): the last defined value against the first."""
    defined = F.when(F.col("value").isNotNull(), F.struct("start", "value"))
    ends = long.groupBy("asset_uid", "metric").agg(F.min(defined)["value"].alias("a"), F.max(defined)["value"].alias("z"), F.count("value").alias("n"))
    change = (F.col("z") - F.col("a")) / F.abs("a")
    word = (
        F.when(F.col("n") < 2, "insufficient data")
        .when((F.col("a") == 0) & (F.col("z") == 0), "flat at zero")
        .when(F.col("a") == 0, "rising from zero")
        .when(change > MATERIAL_CHANGE, "rising")
        .when(change < -MATERIAL_CHANGE, "falling")
        .otherwise("flat")
    )
    return ends.select("asset_uid", "metric", word.alias("direction"))


def latest_per_asset(report: DataFrame) -> DataFrame:
    """The last window's row of every asset."""
    w = Window.partitionBy("asset_uid").orderBy(F.desc("window_id"))
    return report.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
