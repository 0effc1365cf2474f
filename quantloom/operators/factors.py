"""Factor queries and screening."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.exprs import guarded_corr
from quantloom.functions.predicates import between, members
from quantloom.operators.pit import latest
from quantloom.operators.selection import quantiles

KEY = ("trade_date", "stock_code")
LONG_KEY = ("trade_date", "stock_code", "factor_name")


def resolve(name: str, long: DataFrame, wide: DataFrame | None = None, history: DataFrame | None = None, as_of: str | None = None) -> tuple[str, DataFrame]:
    """Which table answers: wide without as-of, history with it, else long."""
    if as_of is None and wide is not None and name in wide.columns:
        return "wide", wide
    if as_of is not None and history is not None:
        return "history", history
    return "long", long


def factor(name: str, long: DataFrame, wide: DataFrame | None = None, history: DataFrame | None = None, codes: Sequence[str] = (), start: dt.date | None = None, end: dt.date | None = None, as_of: str | None = None) -> DataFrame:
    """(trade_date, stock_code, factor_name, factor_value), newest visible version of each."""
    kind, table = resolve(name, long, wide, history, as_of)
    table = members(between(table, start, end), codes)
    if kind == "wide":
        return table.filter(F.col(name).isNotNull()).select(*KEY, F.lit(name).alias("factor_name"), F.col(name).alias("factor_value"))
    return latest(table.filter(F.col("factor_name") == name), LONG_KEY, as_of).select(*LONG_KEY, "factor_value")


def cross_section(name: str, date: dt.date, long: DataFrame, wide: DataFrame | None = None, as_of: str | None = None) -> DataFrame:
    rows = factor(name, long, wide, start=date, end=date, as_of=as_of)
    return rows.select("stock_code", "factor_value").orderBy(F.desc_nulls_last("factor_value"), "stock_code")


def factor_matrix(names: Sequence[str], long: DataFrame, codes: Sequence[str] = (), start: dt.date | None = None, end: dt.date | None = None, as_of: str | None = None) -> DataFrame:
    """A column for each factor; versions that tie are averaged, rows without any value do not appear."""
    rows = members(between(long, start, end), codes).filter(F.col("factor_name").isin(list(names)))
    rows = latest(rows, LONG_KEY, as_of).filter(F.col("factor_value").isNotNull())
    return rows.groupBy(*KEY).pivot("factor_name", list(names)).agg(F.avg("factor_value"))


def value_stats(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, mean, sample deviation, least, most, median; one row of nulls for no rows and no ``by``.

    The median is exact and found by selection, so that no task holds the values of a group.
    """
    stats = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))
    middle = quantiles(rows, value, 0.5, by, "median").withColumnsRenamed({c: f"_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return stats.join(middle, same, "left").drop(*(f"_{c}" for c in by))


def factor_stats(name: str, long: DataFrame, date: dt.date | None = None) -> DataFrame:
    return value_stats(factor(name, long, start=date, end=date), "factor_value")


def ic_series(values: DataFrame, prices: DataFrame, days: int = 1, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Per date the correlation of factor rank and rank of the return to the ``days``-th next priced date.

    values(trade_date, stock_code, factor_value), prices(trade_date, stock_code, close), one row
    per key. Dates filter the factor date; ties take the least rank; nulls rank last.
    """
    dates = prices.select("trade_date").distinct()  # a row a date: some hundred kilobytes in a century, so that it may be broadcast
    later = dates.withColumn("next_date", F.lead("trade_date", days).over(Window.orderBy("trade_date")))  # a row per date
    # a stock's price on that date, if it has one, is among its next ``days`` prices
    order = Window.partitionBy("stock_code").orderBy("trade_date")
    there = lambda k: F.lead("trade_date", k).over(order) == F.col("next_date")
    moves = prices.select("trade_date", "stock_code", "close").join(F.broadcast(later), "trade_date")
    moves = moves.withColumns({"_is": F.coalesce(*(F.when(there(k), True) for k in range(1, days + 1))), "_then": F.coalesce(*(F.when(there(k), F.lead("close", k).over(order)) for k in range(1, days + 1)))})
    moves = moves.filter("_is").select("trade_date", "stock_code", (F.try_divide("_then", "close") - 1).alias("forward"))
    both = between(values, start, end).join(moves, list(KEY))
    rank = lambda c: F.rank().over(Window.partitionBy("trade_date").orderBy(F.asc_nulls_last(c))).cast("double")
    ranked = both.select("trade_date", rank("factor_value").alias("x"), rank("forward").alias("y"))
    return ranked.groupBy("trade_date").agg(guarded_corr("x", "y").alias("ic"), F.count(F.lit(1)).alias("n"))


def factor_names(long: DataFrame) -> DataFrame:
    return long.select("factor_name").distinct().orderBy("factor_name")


def coverage(name: str, long: DataFrame, prices: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Per priced date the share of its stocks with the factor; a date without the factor has null."""
    priced = between(prices, start, end).groupBy("trade_date").agg(F.countDistinct("stock_code").alias("n_priced"))
    have = between(long, start, end).filter(F.col("factor_name") == name).groupBy("trade_date").agg(F.countDistinct("stock_code").alias("n_factor"))
    return priced.join(have, "trade_date", "left").withColumn("coverage", F.try_divide("n_factor", "n_priced"))


def screen(long: DataFrame, date: dt.date, conditions: Sequence[str], layout: str = "long", names: Sequence[str] = (), sort_by: str | None = None, ascending: bool = True, limit: int | None = None) -> DataFrame:
    """Rows of a date that meet all conditions (SQL text over the long columns, or over factor columns for ``wide``)."""
    rows = factor_matrix(names, long, start=date, end=date) if layout == "wide" else latest(between(long, date, date), LONG_KEY)
    for c in conditions:
        rows = rows.filter(F.expr(c))
    if sort_by is not None:
        rows = rows.orderBy(F.asc_nulls_last(sort_by) if ascending else F.desc_nulls_last(sort_by), "stock_code")
    return rows if limit is None else rows.limit(limit)


def rank_by_factors(long: DataFrame, date: dt.date, directions: Mapping[str, int], limit: int | None = None, require_all: bool = True) -> DataFrame:
    """Stocks by the sum of their ranks; the best value of a factor has the highest rank (1: large is good, -1: small)."""
    rows = latest(between(long, date, date).filter(F.col("factor_name").isin(list(directions))), LONG_KEY).filter(F.col("factor_value").isNotNull())
    sign = F.create_map(*(x for k, v in directions.items() for x in (F.lit(k), F.lit(float(v)))))
    rows = rows.withColumn("signed", F.col("factor_value") * sign[F.col("factor_name")])
    rows = rows.withColumn("r", F.rank().over(Window.partitionBy("factor_name").orderBy("signed")))
    scores = rows.groupBy("stock_code").agg(F.sum("r").alias("score"), F.countDistinct("factor_name").alias("n_factors"))
    if require_all:
        scores = scores.filter(F.col("n_factors") == len(directions))
    scores = scores.orderBy(F.desc("score"), "stock_code")
    return scores if limit is None else scores.limit(limit)


def industry_distribution(info: DataFrame, codes: Sequence[str]) -> DataFrame:
    counts = members(info, codes).groupBy("industry").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def quantile_stocks(long: DataFrame, name: str, date: dt.date, q: float, top: bool = True) -> DataFrame:
    """Stocks at or beyond the quantile of the date's values: the upper ``q`` share, or the lower."""
    rows = factor(name, long, start=date, end=date)
    edge = quantiles(rows, "factor_value", 1 - q if top else q, name="edge")
    joined = rows.join(F.broadcast(edge))  # one row
    return joined.filter(F.col("factor_value") >= F.col("edge") if top else F.col("factor_value") <= F.col("edge")).select("stock_code", "factor_value")
