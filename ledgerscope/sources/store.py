"""Landed responses: an append-only Parquet table by source and dataset, of which the newest entry of a request answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.functions.keys import request_digest


def with_digest(responses: DataFrame) -> DataFrame:
    """Adds the request digest and its two-digit shard. Needs source, dataset and params (a map)."""
    out = responses.withColumn("digest", request_digest(F.col("source"), F.col("dataset"), F.col("params")))
    return out.withColumn("shard", F.substring("digest", 1, 2))


def put(responses: DataFrame, path: str) -> None:
    """Appends; the newest wins when read. A retrieved_at without a zone is refused."""
    if isinstance(responses.schema["retrieved_at"].dataType, T.TimestampNTZType):
        raise ValueError("retrieved_at must carry a zone")
    with_digest(responses).write.mode("append").partitionBy("source", "dataset").parquet(path)


def get(stored: DataFrame, ttl_seconds: int | None = None, now: Column | None = None) -> DataFrame:
    """The newest response of each request, if it is not older than ``ttl_seconds`` (None: never too old)."""
    columns = [c for c in stored.columns if c != "digest"]
    out = stored.groupBy("digest").agg(F.max_by(F.struct(*columns), F.col("retrieved_at")).alias("r")).select("digest", "r.*")
    if ttl_seconds is not None:
        out = out.filter(F.col("retrieved_at") >= (now if now is not None else F.current_timestamp()) - F.make_dt_interval(secs=F.lit(float(ttl_seconds)).cast("decimal(18,6)")))
    return out


def without_faults(stored: DataFrame) -> DataFrame:
    """Leaves out bodies that hold an error member."""
    return stored.filter(F.get_json_object("body", "$.error").isNull())


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The entries as written by ``put``, with the declared schema of the responses, so that an empty store can be read too."""
    full = T.StructType([*[f for f in schema if f.name not in ("source", "dataset")], T.StructField("digest", T.StringType()), T.StructField("shard", T.StringType())])
    full = T.StructType([*full, T.StructField("source", T.StringType()), T.StructField("dataset", T.StringType())])
    return spark.read.schema(full).parquet(path)


def clear(spark: SparkSession, path: str, source: str | None = None) -> None:
    """Deletes all entries, or one source's: its partition folders, nothing is rewritten."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(top):
        return
    for entry in files.listStatus(top):
        name = entry.getPath().getName()
        if entry.isDirectory() and name.startswith("source=") and (source is None or name == f"source={_escaped(spark, source)}"):
            files.delete(entry.getPath(), True)


def _escaped(spark: SparkSession, value: str) -> str:
    """A value as a partition folder has it."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)
