"""Exact quantiles by distributed selection: the value of a rank is found without sorting or gathering all values.

Each round counts the values between two bounds in bins that keep their order, and narrows the bounds to the least
and greatest value of the bin that holds the rank. The first bins are even in the logarithm, so that a
bin spans a factor of little more than two at most, and later ones even in the value; each round leaves a 1,024th of the span. Once few
enough values are left they are sorted. What a task holds is a count for each bin and group,
however many rows there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.sources.sinks import scratch

BINS, FEW = 1024, 10_000


def order_key(value: Column) -> Column:
    """The logarithm with the value's sign: equal or greater for a greater value, and even over all magnitudes."""
    size = F.log(F.abs(value)) + 800  # positive for every double but zero
    return F.when(value > 0, size).when(value < 0, -size).otherwise(0.0)


def bin_of(value: Column, low: Column, high: Column) -> Column:
    """Bin of a value between two bounds; a greater value never has a lower bin."""
    share = lambda x, a, b: F.when(b > a, F.floor((x - a) / (b - a) * (BINS - 1))).otherwise(F.lit(0)).cast("int")
    wide = ~((low > 0) & (high < 4 * low)) & ~((high < 0) & (low > 4 * high))
    return F.when(wide, share(order_key(value), order_key(low), order_key(high))).otherwise(share(value / 2, low / 2, high / 2))


def with_bounds(rows: DataFrame, bounds: DataFrame, by: Sequence[str], groups: int) -> DataFrame:
    """Rows between their group's bounds, once for each rank sought."""
    right = bounds.withColumnsRenamed({c: f"_{c}" for c in by})
    same = (F.col("_value") >= F.col("_low")) & (F.col("_value") <= F.col("_high"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(F.broadcast(right) if groups <= 100_000 else right, same).drop(*(f"_{c}" for c in by))


def ranked_values(rows: DataFrame, wanted: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, _rank, value): the value of each rank of ``wanted(by, _rank, _low, _high, _below, _left)``.

    ``rows(by, _value)`` is read once a round; ``_low`` and ``_high`` bound the rank's value, ``_below``
    values are less than ``_low`` and ``_left`` are between the two.
    """
    spark = rows.sparkSession
    keys = [*by, "_rank"]

    def written(df: DataFrame) -> DataFrame:
        path = scratch(spark)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    bounds = written(wanted)
    groups = bounds.count()
    while bounds.filter((F.col("_left") > FEW) & (F.col("_low") < F.col("_high"))).count():
        open_ = bounds.filter((F.col("_left") > FEW) & (F.col("_low") < F.col("_high")))
        seen = with_bounds(rows, open_, by, groups).withColumn("_bin", bin_of(F.col("_value"), F.col("_low"), F.col("_high")))
        bins = seen.groupBy(*keys, "_below", "_bin").agg(F.count(F.lit(1)).alias("n"), F.min("_value").alias("a"), F.max("_value").alias("b"))
        under = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bins = bins.withColumn("_below", F.col("_below") + under).filter((F.col("_below") <= F.col("_rank")) & (F.col("_rank") < F.col("_below") + F.col("n")))
        closer = bins.select(*keys, F.col("a").alias("_low"), F.col("b").alias("_high"), "_below", F.col("n").alias("_left"))
        rest = bounds.filter((F.col("_left") <= FEW) | (F.col("_low") >= F.col("_high")))
        bounds = written(rest.select(*closer.columns).union(closer))
    same = bounds.filter("_low >= _high").select(*keys, F.col("_low").alias("value"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_value")) - 1 + F.col("_below")
    some = with_bounds(rows, bounds.filter("_low < _high"), by, groups).withColumn("_place", place)
    return same.union(some.filter(F.col("_place") == F.col("_rank")).select(*keys, F.col("_value").alias("value")))


def quantiles(df: DataFrame, value: str, share: float, by: Sequence[str] = (), name: str = "quantile") -> DataFrame:
    """(by, ``name``): the exact quantile of non-null values of each group, interpolated between neighbours.

    A group without values does not appear; NaN counts as greater than all. Values are written once to a
    shared folder and read once a round; there are some six rounds at most.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    kept = df.select(*by, F.col(value).cast("double").alias("_value")).filter(F.col("_value").isNotNull())
    kept.write.parquet(path)
    rows = spark.read.schema(kept.schema).parquet(path)
    finite = ~F.isnan("_value") & (F.abs("_value") < float("inf"))
    stats = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col("_value") == float("-inf"), 1)).alias("_under"), F.count(F.when(finite, 1)).alias("_finite"),
        F.count(F.when(F.isnan("_value"), 1)).alias("_nans"), F.min(F.when(finite, F.col("_value"))).alias("_low"), F.max(F.when(finite, F.col("_value"))).alias("_high"),
    ).filter("_n > 0")
    at = (F.col("_n") - 1) * F.lit(float(share))
    ranks = stats.withColumn("_at", at).select("*", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_rank"))
    inner = (F.col("_rank") >= F.col("_under")) & (F.col("_rank") < F.col("_under") + F.col("_finite"))
    found = ranked_values(rows.filter(finite), ranks.filter(inner).select(*by, "_rank", "_low", "_high", F.col("_under").alias("_below"), F.col("_finite").alias("_left")), by)
    beyond = F.when(F.col("_rank") < F.col("_under"), float("-inf")).when(F.col("_rank") >= F.col("_n") - F.col("_nans"), float("nan")).otherwise(float("inf"))
    values = found.select(*by, "_rank", "value").union(ranks.filter(~inner).select(*by, "_rank", beyond.alias("value")))
    pairs = values.withColumnsRenamed({c: f"_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = stats.withColumn("_at", at).join(pairs, same)
    low, high = F.min_by("value", "_rank"), F.max_by("value", "_rank")
    part = F.first("_at") - F.floor(F.first("_at"))
    return met.groupBy(*by).agg(F.when(low == high, low).otherwise(low + (high - low) * part).alias(name))
