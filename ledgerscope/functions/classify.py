"""Kinds and categories of transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.schemas import BURN


def is_burn(address: Column) -> Column:
    return F.lower(address).isin(*BURN)


def with_issuer_flags(transfers: DataFrame, issuers: DataFrame) -> DataFrame:
    """Adds from_issuer and to_issuer. ``issuers`` (asset_uid, address) is an address list kept by hand."""
    one = issuers.select("asset_uid", F.lower("address").alias("address")).distinct()
    a, b = one.withColumn("from_issuer", F.lit(True)), one.withColumn("to_issuer", F.lit(True))
    out = transfers.withColumn("__f", F.lower("from_address")).withColumn("__t", F.lower("to_address"))
    out = out.join(a.withColumnRenamed("address", "__f"), ["asset_uid", "__f"], "left").join(b.withColumnRenamed("address", "__t"), ["asset_uid", "__t"], "left")
    return out.drop("__f", "__t").fillna(False, ["from_issuer", "to_issuer"])


def kind() -> Column:
    """Needs from_address, to_address and the issuer flags. The issuer as sender is tested before a burn as recipient."""
    f, t = is_burn(F.col("from_address")), is_burn(F.col("to_address"))
    return (
        F.when(f & t, "unclassified").when(f | F.col("from_issuer"), "mint").when(t | F.col("to_issuer"), "burn").otherwise("secondary")
    )


def category() -> Column:
    """The panel's category: creation and destruction come before the issuer label."""
    f, t = is_burn(F.col("from_address")), is_burn(F.col("to_address"))
    return (
        F.when(f & t, "unresolved").when(f, "creation").when(t, "destruction").when(F.col("from_issuer") | F.col("to_issuer"), "issuer_linked").otherwise("residual")
    )


def classify(transfers: DataFrame, issuers: DataFrame) -> DataFrame:
    """Transfers with ``kind`` and ``category``."""
    out = with_issuer_flags(transfers, issuers)
    return out.withColumn("kind", kind()).withColumn("category", category()).drop("from_issuer", "to_issuer")


def invisible_issuance(classified: DataFrame, issuers: DataFrame) -> DataFrame:
    """Per asset: whether all transfers are secondary and no issuer is configured, so that issuance cannot be seen."""
    known = issuers.select("asset_uid").distinct().withColumn("known", F.lit(True))
    found = classified.groupBy("asset_uid").agg(F.bool_and(F.col("kind") == "secondary").alias("all_secondary"))
    return found.join(known, "asset_uid", "left").select("asset_uid", (F.col("all_secondary") & F.col("known").isNull()).alias("invisible_issuance"))


def participates() -> Column:
    """Residual, of a positive amount, between two addresses."""
    return (F.col("category") == "residual") & (F.col("amount") > 0) & (F.lower("from_address") != F.lower("to_address"))
