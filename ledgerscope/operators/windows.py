"""Observation windows and the assignment of facts to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windows_ending(spark: SparkSession, end: str, days: int, periods: int) -> DataFrame:
    """``periods`` consecutive windows of ``days`` days, oldest first, the last one ending at ``end``: window_id, start, end, and for ``assign`` nth, length and offset."""
    if days <= 0 or periods <= 0:
        raise ValueError("days and periods must be positive")
    k = spark.range(1).select(F.explode(F.sequence(F.lit(periods - 1), F.lit(0), F.lit(-1))).alias("k"))
    at = lambda n: F.to_timestamp(F.lit(end)) - F.make_dt_interval(days=n * days)
    length = F.lit(days * 86_400_000_000)
    offset = F.pmod(F.unix_micros(at(F.lit(0))), length)
    return k.select(
        F.date_format(at(F.col("k")), "yyyy-MM-dd").alias("window_id"), at(F.col("k") + 1).alias("start"), at(F.col("k")).alias("end"),
        F.floor((F.unix_micros(at(F.col("k") + 1)) - offset) / length).alias("nth"), length.alias("length"), offset.alias("offset"),
    )


def _month_windows(month: DataFrame) -> DataFrame:
    return month.select(F.date_format("m", "yyyy-MM").alias("window_id"), F.to_timestamp("m").alias("start"), F.to_timestamp(F.add_months("m", 1)).alias("end"), F.col("m").alias("month"))


def months(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Calendar months from ``first`` to ``last`` (YYYY-MM, both inclusive): window_id, start, end, and month for ``assign``. A reversed range is refused."""
    if last < first:
        raise ValueError(f"{last} is before {first}")
    month = F.explode(F.sequence(F.to_date(F.lit(f"{first}-01")), F.to_date(F.lit(f"{last}-01")), F.expr("interval 1 month")))
    return _month_windows(spark.range(1).select(month.alias("m")))


def months_of(facts: DataFrame, time: str = "block_time") -> DataFrame:
    """All calendar months from the first to the last of the facts, as ``months``; none without facts. A one-row aggregate finds the two."""
    span = facts.agg(F.trunc(F.min(time), "month").alias("a"), F.trunc(F.max(time), "month").alias("b")).filter("a IS NOT NULL")
    return _month_windows(span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m")))


def assign(facts: DataFrame, windows: DataFrame, time: str = "block_time") -> DataFrame:
    """Facts with the windows that hold them, start <= time < end.

    Windows that tile are found by an equal key: months by the month, those of ``windows_ending`` by their number. Any
    other list, a declared one of a few rows, is a range join. The windows are broadcast.
    """
    at = F.col(time)
    bounds = ["window_id", "start", "end"]
    if "month" in windows.columns:
        w = windows.select(*bounds, F.col("month").alias("__key"))
        return facts.withColumn("__key", F.trunc(time, "month")).join(F.broadcast(w), "__key").drop("__key")
    if "nth" in windows.columns:
        rule = windows.agg(F.first("length").alias("__length"), F.first("offset").alias("__offset"))
        keyed = facts.crossJoin(F.broadcast(rule)).withColumn("__key", F.floor((F.unix_micros(at) - F.col("__offset")) / F.col("__length")))
        return keyed.drop("__length", "__offset").join(F.broadcast(windows.select(*bounds, F.col("nth").alias("__key"))), "__key").drop("__key")
    return facts.join(F.broadcast(windows.select(*bounds)), (at >= F.col("start")) & (at < F.col("end")))


def assign_month(facts: DataFrame, time: str = "block_time") -> DataFrame:
    """Facts with their calendar month, by an expression and no join: for windows that tile."""
    return facts.withColumn("window_id", F.date_format(time, "yyyy-MM"))


def block_ranges(blocks: DataFrame, windows: DataFrame, head: int | None = None) -> DataFrame:
    """First and last block stamped within each window, none beyond ``head``; an empty window has null bounds."""
    b = blocks if head is None else blocks.filter(F.col("number") <= head)
    found = assign(b, windows, "timestamp").groupBy("window_id").agg(F.min("number").alias("first_block"), F.max("number").alias("last_block"))
    return windows.select("window_id").join(found, "window_id", "left")
