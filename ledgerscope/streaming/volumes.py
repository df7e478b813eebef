"""Transfer volumes over a stream: tumbling windows by event time, late rows dropped behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_volumes(transfers: DataFrame, length: str = "1 day", late: str = "2 days", key: str = "asset_uid", time: str = "block_time", amount: str = "amount") -> DataFrame:
    """Per key and window: transfers and volume. Works on a stream and, for the same rows, on a table."""
    rows = transfers.withWatermark(time, late) if transfers.isStreaming else transfers
    out = rows.groupBy(F.window(time, length), F.col(key)).agg(F.count("*").alias("n"), F.sum(amount).alias("volume"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "volume")
