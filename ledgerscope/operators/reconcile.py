"""What sources say about one asset, held against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.schemas import DISAGREEMENT_TOLERANCE, STALE_DAYS

FIELDS = ("total_supply", "market_value_usd", "price_usd", "holder_count")


def latest_by_source(snapshots: DataFrame) -> DataFrame:
    w = Window.partitionBy("asset_uid", "source").orderBy(F.desc("as_of"))
    return snapshots.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def long_fields(snapshots: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Newest reports as (asset_uid, source, as_of, field, value), nulls left out."""
    have = [f for f in fields if f in snapshots.columns]
    one = latest_by_source(snapshots).select("asset_uid", "source", "as_of", *[F.col(f).cast("double").alias(f) for f in have])
    return one.unpivot(["asset_uid", "source", "as_of"], have, "field", "value").filter("value IS NOT NULL")


def comparisons(long: DataFrame) -> DataFrame:
    """Every pair of sources, the lesser name first, with the relative difference, the gap in hours and whether it is too large to compare."""
    pick = lambda x: long.select("asset_uid", "field", *[F.col(c).alias(f"{c}_{x}") for c in ("source", "as_of", "value")])
    p = pick("a").join(pick("b"), ["asset_uid", "field"]).filter("source_a < source_b")
    size = F.greatest(F.abs("value_a"), F.abs("value_b"))
    gap = F.abs(F.unix_micros(F.col("as_of_a").cast("timestamp")) - F.unix_micros(F.col("as_of_b").cast("timestamp")))
    return (
        p.withColumn("relative_difference", F.when(size == 0, F.lit(0.0)).otherwise(F.abs(F.col("value_a") - F.col("value_b")) / size))
        .withColumn("gap_hours", gap / 3_600_000_000)
        .withColumn("stale", gap > STALE_DAYS * 86_400_000_000)
    )


def disagreements(compared: DataFrame, tolerance: float = DISAGREEMENT_TOLERANCE) -> DataFrame:
    return compared.filter(F.col("relative_difference") > tolerance)


def worst_first(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("relative_difference"), "asset_uid", "field", "source_a", "source_b")


def uncheckable(long: DataFrame) -> DataFrame:
    """(asset, field) that one source alone reports."""
    return long.groupBy("asset_uid", "field").agg(F.count_distinct("source").alias("n")).filter("n = 1").drop("n")


def agreement(compared: DataFrame, tolerance: float = DISAGREEMENT_TOLERANCE) -> DataFrame:
    return compared.agg(F.count("*").alias("compared"), F.count_if(F.col("relative_difference") > tolerance).alias("disagreements"))


def readable(c: str) -> F.Column:
    """Thousands separators and no decimals from 1,000 up, else four significant digits."""
    v, size = F.col(c), F.abs(F.col(c))
    scale = F.pow(F.lit(10.0), 3 - F.floor(F.log10(size)))
    plain = F.regexp_replace((F.bround(v * scale) / scale).cast("decimal(20,8)").cast("string"), r"\.?0+$", "")
    tiny = F.regexp_replace(F.format_string("%.3e", v), r"\.?0+e", "e")
    return F.when(size >= 1000, F.format_number(v, 0)).when(size == 0, "0").when(size < 1e-4, tiny).otherwise(plain)


def describe(found: DataFrame) -> DataFrame:
    """Adds one line of text a row."""
    text = F.concat(
        F.col("asset_uid"), F.lit(" "), F.col("field"), F.lit(": "), F.col("source_a"), F.lit("="), readable("value_a"), F.lit(" vs "), F.col("source_b"), F.lit("="), readable("value_b"),
        F.format_string(" (%.1f%% apart)", F.col("relative_difference") * 100), F.when(F.col("stale"), F.lit(" (observations too far apart to compare)")).otherwise(""),
    )
    return found.withColumn("description", text)
