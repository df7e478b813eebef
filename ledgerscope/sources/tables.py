"""Typed CSV scans, the three tables of a dataset, dimension tables, and sinks."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.operators.validate import InvalidFrame, validate
from ledgerscope.schemas import HOLDERS, SNAPSHOTS, TRANSFERS, Table

#: Fixed value: how the panel file writes its timestamps.
PANEL_TIME = "yyyy-MM-dd'T'HH:mm:ss'Z'"


@dataclass(frozen=True)
class Dataset:
    snapshots: DataFrame
    transfers: DataFrame
    holders: DataFrame


def read_csv(spark: SparkSession, path: str, table: Table, time_format: str = "yyyy-MM-dd'T'HH:mm:ssXXX") -> DataFrame:
    """Columns by header name with declared types; every file is read as text first, so a file's order does not matter."""
    raw = spark.read.option("header", True).csv(path)
    lacking = [f.name for f in table.schema if f.name not in raw.columns]
    if lacking:
        raise InvalidFrame(f"{path} lacks {', '.join(lacking)}")
    cell = lambda f: F.to_timestamp(f.name, time_format) if isinstance(f.dataType, T.TimestampType) else F.col(f.name).cast(f.dataType)
    return raw.select(*[cell(f).alias(f.name) for f in table.schema])


def load_dataset(spark: SparkSession, folder: str) -> Dataset:
    """The three tables of a folder of CSV files, validated."""
    read = lambda t: validate(read_csv(spark, f"{folder.rstrip('/')}/{t.name}.csv", t), t, f"{t.name}.csv")
    return Dataset(read(SNAPSHOTS), read(TRANSFERS), read(HOLDERS))


def asset_dimension(rows: DataFrame) -> DataFrame:
    """Assets (asset_uid, symbol); duplicates and missing fields are refused."""
    bad = rows.filter(F.col("asset_uid").isNull() | F.col("symbol").isNull() | (F.col("symbol") == "")).limit(1).count()
    twice = rows.groupBy("asset_uid").count().filter("count > 1").limit(1).count()
    if bad or twice:
        raise InvalidFrame("an asset is listed twice" if twice else "an asset lacks a field")
    return rows.select("asset_uid", "symbol")


def address_dimension(rows: DataFrame) -> DataFrame:
    """Known addresses (asset_uid, role, address, note), lower case; one without a note is refused."""
    if rows.filter(F.coalesce(F.trim("note"), F.lit("")) == "").limit(1).count():
        raise InvalidFrame("a known address has no note")
    return rows.select("asset_uid", "role", F.lower("address").alias("address"), "note").distinct()


def write(df: DataFrame, path: str, time_format: str | None = None) -> None:
    """CSV or Parquet by suffix; any other is refused. Writers make missing folders."""
    suffix = PurePosixPath(path).suffix
    if suffix == ".csv":
        df.write.mode("overwrite").option("header", True).option("timestampFormat", time_format or "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(path)
    elif suffix == ".parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown format {suffix or path}")
