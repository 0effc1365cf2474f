"""Macro, alternative-data and cross-source queries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.exprs import days_behind, guarded_corr
from quantloom.functions.predicates import between, members
from quantloom.operators.factors import value_stats

#: Names of the four regimes (hot, recovery, stagflation, recession).
REGIMES = {"hot": "过热", "recovery": "复苏", "stagflation": "滞胀", "recession": "衰退"}


def macro_data(macro: DataFrame, ids: Sequence[str] = (), start: dt.date | None = None, end: dt.date | None = None, value_type: str = "raw") -> DataFrame:
    return members(between(macro, start, end), ids, "indicator_id").filter(F.col("value_type") == value_type).orderBy("trade_date", "indicator_id")


def macro_matrix(macro: DataFrame, ids: Sequence[str], start: dt.date | None = None, end: dt.date | None = None, value_type: str = "raw") -> DataFrame:
    return macro_data(macro, ids, start, end, value_type).groupBy("trade_date").pivot("indicator_id", list(ids)).agg(F.first("value"))


def indicators(dimension: DataFrame, category: str | None = None) -> DataFrame:
    return (dimension if category is None else dimension.filter(F.col("category") == category)).orderBy("indicator_id")


def indicator_stats(macro: DataFrame) -> DataFrame:
    return value_stats(macro, "value", "indicator_id", "value_type")


def latest_values(macro: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """All value types on the last date of each indicator."""
    last = F.max("trade_date").over(Window.partitionBy("indicator_id"))
    return members(macro, ids, "indicator_id").withColumn("_last", last).filter("trade_date = _last").drop("_last")


def by_categories(macro: DataFrame, dimension: DataFrame, start: dt.date, end: dt.date, categories: Sequence[str] = ()) -> DataFrame:
    return between(macro, start, end).join(members(dimension, categories, "category").select("indicator_id", "category"), "indicator_id")


def year_on_year(macro: DataFrame, periods: int = 12, value_type: str = "raw") -> DataFrame:
    """Percent change to so many rows before, for every indicator."""
    before = F.lag("value", periods).over(Window.partitionBy("indicator_id").orderBy("trade_date"))
    rows = macro.filter(F.col("value_type") == value_type).withColumn("previous", before).filter(F.col("previous").isNotNull())
    return rows.select("trade_date", "indicator_id", "value", "previous", (F.try_divide(F.col("value") - F.col("previous"), "previous") * 100).alias("yoy"))


def regime(pmi, cpi):
    """Name of the regime; a null makes every comparison false, which is a recession."""
    hot, high = F.coalesce(pmi >= 50, F.lit(False)), F.coalesce(cpi >= 2, F.lit(False))
    cold, low = F.coalesce(pmi < 50, F.lit(False)), F.coalesce(cpi < 2, F.lit(False))
    return F.when(hot & high, REGIMES["hot"]).when(hot & low, REGIMES["recovery"]).when(cold & high, REGIMES["stagflation"]).otherwise(REGIMES["recession"])


def macro_regime(macro: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    wide = macro_matrix(macro, ["PMI", "CPI_yoy"], start, end)
    return wide.select("trade_date", regime(F.col("PMI"), F.col("CPI_yoy")).alias("regime"))


def alternative(data: DataFrame, data_type: str, subtype: str | None = None, entity_type: str | None = None, entity_id: str | None = None, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    rows = between(data.filter(F.col("data_type") == data_type), start, end)
    for column, value in (("data_subtype", subtype), ("entity_type", entity_type), ("entity_id", entity_id)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows.orderBy("trade_date", "data_id")


def time_series(data: DataFrame, data_type: str, entity_id: str, subtype: str | None = None) -> DataFrame:
    return alternative(data, data_type, subtype, entity_id=entity_id).select("trade_date", "data_id", "value")


def satellite_data(data: DataFrame, **kw) -> DataFrame:
    return alternative(data, "satellite", **kw)


def chain_data(data: DataFrame, **kw) -> DataFrame:
    return alternative(data, "chain", **kw)


def e_commerce_data(data: DataFrame, **kw) -> DataFrame:
    return alternative(data, "e_commerce", **kw)


def entities(data: DataFrame, data_type: str, subtype: str | None = None) -> DataFrame:
    return alternative(data, data_type, subtype).select("entity_type", "entity_id").distinct()


def latest_alternative(data: DataFrame, data_type: str, subtype: str | None = None) -> DataFrame:
    """Rows on the last date of the whole filter."""
    rows = alternative(data, data_type, subtype)
    last = rows.agg(F.max("trade_date").alias("_last"))
    return rows.join(F.broadcast(last), F.col("trade_date") == F.col("_last")).drop("_last")  # one row


def alternative_stats(data: DataFrame, data_type: str) -> DataFrame:
    return value_stats(data.filter(F.col("data_type") == data_type), "value", "entity_id")


def correlation_with_price(data: DataFrame, prices: DataFrame, data_type: str, entity_id: str, lag: int = 0) -> DataFrame:
    """Per subtype and stock, with the close so many calendar days later; prices have one row per key."""
    rows = data.filter((F.col("data_type") == data_type) & (F.col("entity_id") == entity_id)).select("trade_date", "data_subtype", "value")
    moved = prices.select(F.date_sub("trade_date", lag).alias("trade_date"), "stock_code", "close")
    return rows.join(moved, "trade_date").groupBy("data_subtype", "stock_code").agg(guarded_corr("value", "close").alias("corr"), F.count(F.lit(1)).alias("n"))


def data_by_source(macro: DataFrame, data: DataFrame, source: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    parts = [between(t.filter(F.col("source_id") == source), start, end).withColumn("source_table", F.lit(n)) for t, n in ((macro, "macro_data"), (data, "alternative_data"))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).orderBy(F.desc("trade_date"))


def latest_macro(macro: DataFrame, dimension: DataFrame, ids: Sequence[str] = (), limit: int = 100) -> DataFrame:
    rows = members(macro, ids, "indicator_id").join(dimension.select("indicator_id", "category"), "indicator_id", "left")
    return rows.orderBy(F.desc("trade_date"), "indicator_id", "value_type").limit(limit)


def cross_source(macro: DataFrame, factors: DataFrame, ids: Sequence[str], names: Sequence[str], code: str | None = None) -> DataFrame:
    """Indicators and one stock's factors side by side on the date; without a stock the indicators as long rows."""
    if code is None:
        return members(macro.filter("value_type = 'raw'"), ids, "indicator_id").select("trade_date", "indicator_id", "value").orderBy("trade_date", "indicator_id")
    left = macro.filter("value_type = 'raw'").groupBy("trade_date").pivot("indicator_id", list(ids)).agg(F.avg("value"))
    right = factors.filter(F.col("stock_code") == code).groupBy("trade_date").pivot("factor_name", list(names)).agg(F.avg("factor_value"))
    return left.join(right, "trade_date", "full_outer")


def source_summary(macro: DataFrame) -> DataFrame:
    return macro.groupBy(F.coalesce("source_id", F.lit("unknown")).alias("source_id")).agg(
        F.count(F.lit(1)).alias("n"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), F.countDistinct("indicator_id").alias("n_indicators")
    )


def freshness(macro: DataFrame, run_date: dt.date) -> DataFrame:
    last = macro.groupBy("indicator_id").agg(F.max("trade_date").alias("last_date"))
    return last.withColumn("days_behind", days_behind("last_date", run_date))
