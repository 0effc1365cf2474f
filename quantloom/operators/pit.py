"""Point-in-time reads of versioned tables: one scan and one shuffle each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("trade_date", "stock_code")


def visible(df: DataFrame, as_of: str | None, version: str = "loaded_at") -> DataFrame:
    """Versions loaded at or before ``as_of`` (a date means its midnight)."""
    return df if as_of is None else df.filter(F.col(version) <= F.lit(as_of).cast("timestamp"))


def latest(df: DataFrame, key: Sequence[str] = KEY, as_of: str | None = None, non_null: Sequence[str] = (), version: str = "loaded_at") -> DataFrame:
    """Rows of the newest visible version of each key, ties included; versions with nulls in ``non_null`` do not count."""
    df = visible(df, as_of, version)
    for c in non_null:
        df = df.filter(F.col(c).isNotNull())
    newest = F.rank().over(Window.partitionBy(*key).orderBy(F.col(version).desc_nulls_last()))
    return df.withColumn("_newest", newest).filter("_newest = 1").drop("_newest")


def latest_fields(df: DataFrame, fields: Sequence[str], key: Sequence[str] = KEY, as_of: str | None = None, version: str = "loaded_at") -> DataFrame:
    """One row per key with the newest non-null value of each field on its own."""
    picks = [F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(version, f))).alias(f) for f in fields]
    return visible(df, as_of, version).groupBy(*key).agg(*picks)


def compacted(df: DataFrame, keep_before: str, key: Sequence[str] = KEY, version: str = "loaded_at") -> DataFrame:
    """Drops versions older than ``keep_before``, except the newest of them for each key."""
    cutoff = F.lit(keep_before).cast("timestamp")
    old = F.max(F.when(F.col(version) < cutoff, F.col(version))).over(Window.partitionBy(*key))
    return df.withColumn("_old", old).filter((F.col(version) >= cutoff) | (F.col(version) == F.col("_old"))).drop("_old")
