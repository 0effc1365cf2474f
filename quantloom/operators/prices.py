"""Daily and intraday price queries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.exprs import adjusted
from quantloom.functions.predicates import QueryFilter, between, members
from quantloom.operators.pit import latest

DAILY = ("trade_date", "stock_code", "open", "high", "low", "close", "volume", "amount", "adj_factor")
TICK = ("trade_date", "trade_sec", "stock_code", "open", "high", "low", "close", "volume", "amount")


def daily(versions: DataFrame, query: QueryFilter = QueryFilter()) -> DataFrame:
    """Newest visible bars with a close, by date and code; the filter on keys goes below the version window."""
    rows = latest(query.rows(versions), as_of=query.as_of, non_null=("close",))
    return rows.select(*(query.fields or DAILY)).orderBy("trade_date", "stock_code")


def level1(ticks: DataFrame, codes: Sequence[str] = (), date: dt.date | None = None, start_sec: int | None = None, end_sec: int | None = None, fields: Sequence[str] = TICK) -> DataFrame:
    """Ticks of a day (a partition where the table is partitioned by date) between two times, both included."""
    rows = members(between(ticks, date, date), codes)
    if start_sec is not None:
        rows = rows.filter(F.col("trade_sec") >= start_sec)
    if end_sec is not None:
        rows = rows.filter(F.col("trade_sec") <= end_sec)
    return rows.select(*fields).orderBy("trade_date", "trade_sec", "stock_code")


def level1_of(ticks: DataFrame, days: DataFrame, fields: Sequence[str] = TICK) -> DataFrame:
    """Ticks of the dates in ``days``, a row a date: of a table partitioned by date only their folders are read.

    The comparison drops nothing but nulls; only with one does Catalyst count on the dates being few and prune by them.
    """
    dates = days.select("trade_date").filter(F.col("trade_date") >= F.lit("0001-01-01").cast("date"))
    rows = ticks.join(F.broadcast(dates), "trade_date", "left_semi")
    return rows.select(*fields).orderBy("trade_date", "trade_sec", "stock_code")


def price_matrix(versions: DataFrame, field: str, codes: Sequence[str], start: dt.date | None = None, end: dt.date | None = None, adjust: str = "none", as_of: str | None = None) -> DataFrame:
    """Dates by the given codes; an explicit list keeps the pivot to one job and a known width."""
    rows = latest(members(between(versions, start, end), codes), as_of=as_of, non_null=(field,))
    rows = rows.withColumn("_v", adjusted(field, "adj_factor", adjust))
    return rows.groupBy("trade_date").pivot("stock_code", list(codes)).agg(F.first("_v")).orderBy("trade_date")


def trade_dates(calendar: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    return between(calendar.filter("is_trading_day"), start, end).select("trade_date").orderBy("trade_date")


def stock_list(info: DataFrame, industry: str | None = None, date: dt.date | None = None) -> DataFrame:
    """Stocks, of one industry if given, listed and not delisted on ``date`` if the table knows."""
    if industry is not None:
        info = info.filter(F.col("industry") == industry)
    if date is not None and "list_date" in info.columns:
        info = info.filter((F.col("list_date") <= F.lit(date)) & (F.col("delist_date").isNull() | (F.col("delist_date") > F.lit(date))))
    return info.select("stock_code", "stock_name", "industry").orderBy("stock_code")


def date_range(versions: DataFrame) -> DataFrame:
    """First and last date; versions do not matter to either."""
    return versions.agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


def panel(rows: DataFrame, fields: Sequence[str], codes: Sequence[str], by: str = "trade_date") -> DataFrame:
    """Per date one array for each field in the order of ``codes``, null where a code has none; one scan for all fields.

    Of several rows of a date and code (versions loaded at one time) each field takes the greatest.
    """
    rows = members(rows, codes).groupBy(by, "stock_code").agg(*(F.max(f).alias(f) for f in fields))
    maps = [F.map_from_entries(F.collect_list(F.struct("stock_code", f))).alias(f) for f in fields]
    slots = F.array(*map(F.lit, codes))
    out = rows.groupBy(by).agg(*maps)
    placed = lambda f: F.transform(slots, lambda c: F.try_element_at(F.col(f), c)).alias(f)
    return out.select(by, *map(placed, fields)).orderBy(by)


def bars(ticks: DataFrame, minutes: int | None = None) -> DataFrame:
    """Bars of so many minutes, or of the day, from ticks."""
    keys = ["stock_code", "trade_date"]
    if minutes is not None:
        ticks = ticks.withColumn("bar_sec", F.col("trade_sec") - F.col("trade_sec") % (60 * minutes))
        keys.append("bar_sec")
    first = F.struct("trade_sec", "event_id") if "event_id" in ticks.columns else F.col("trade_sec")
    return ticks.groupBy(*keys).agg(
        F.min_by("open", first).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", first).alias("close"),
        F.sum("volume").alias("volume"), F.sum("amount").alias("amount"), F.try_divide(F.sum("amount"), F.sum("volume")).alias("vwap"),
    )
