"""Union of sources and the outcome of their collection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows by column name; with none populated the schema stays."""
    return reduce(DataFrame.unionByName, frames)


def missing_kinds(fetches: DataFrame, assets: DataFrame) -> DataFrame:
    """From fetches (asset_uid, source, kind, ok): per asset, kinds that some source could supply but none did. An empty success counts as supplied."""
    wanted = assets.select("asset_uid").crossJoin(F.broadcast(fetches.select("kind").distinct()))
    lacking = wanted.join(fetches.filter("ok").select("asset_uid", "kind").distinct(), ["asset_uid", "kind"], "left_anti")
    return lacking.groupBy("asset_uid").agg(F.array_sort(F.collect_set("kind")).alias("missing_kinds"))


def merge_quality(outcomes: DataFrame) -> DataFrame:
    """From (asset_uid, source_order, dropped, reconciled): dropped summed over sources, the last source's reconciliation kept."""
    return outcomes.groupBy("asset_uid").agg(F.sum("dropped").alias("dropped"), F.max(F.struct("source_order", "reconciled"))["reconciled"].alias("reconciled"))


def contributing_sources(*frames: DataFrame) -> DataFrame:
    """Per asset the sorted distinct sources of several frames."""
    rows = union_sources(*[f.select("asset_uid", "source") for f in frames]).distinct()
    return rows.groupBy("asset_uid").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def assert_one_asset(rows: DataFrame) -> None:
    """Refuses a frame that mixes assets, as the single-asset calls need it."""
    if rows.select("asset_uid").distinct().limit(2).count() > 1:
        raise ValueError("rows of more than one asset")
