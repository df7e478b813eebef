"""The shared folder of a cluster, where iterations cut their lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is named, on one machine only, a temporary one is set here."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not named and held.isDefined():
        return held.get()
    if not named:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def settled(rows: DataFrame) -> DataFrame:
    """The rows written to the shared folder, without their lineage: compressed columns, of which each use reads its own. A checkpoint would hold whole rows as they are in memory."""
    spark = rows.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
