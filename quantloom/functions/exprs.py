"""Column functions: codes, markets, adjustment, buckets, guarded statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_code(c: Column | str) -> Column:
    """Stock code of any form as six digits or more: suffix dropped, left-padded; null becomes empty."""
    bare = F.substring_index(F.trim(col(c).cast("string")), ".", 1)
    return F.coalesce(F.when(F.length(bare) < 6, F.lpad(bare, 6, "0")).otherwise(bare), F.lit(""))


def is_index_code(c: Column | str) -> Column:
    up = F.upper(F.trim(col(c)))
    return F.coalesce(up.endswith(".SH") | up.endswith(".SZ") | up.endswith(".BJ"), F.lit(False))


def market_of(c: Column | str) -> Column:
    """SH, BJ or SZ by the first digit of a six-digit code; else empty."""
    c = col(c)
    first = F.substring(c, 1, 1)
    return F.when(~F.coalesce(c.rlike(r"^\d{6}$"), F.lit(False)), "").when(first == "6", "SH").when(first.isin("8", "9"), "BJ").otherwise("SZ")


def adjusted(price: Column | str, factor: Column | str, how: str = "none") -> Column:
    p, f = col(price), col(factor)
    if how == "none":
        return p
    if how == "forward":
        return p * f
    if how == "backward":
        return F.when(f == 0, p).otherwise(F.try_divide(p, f))
    raise ValueError(f"unknown adjustment: {how}")


def bucket(date: Column | str, freq: str) -> Column:
    if freq == "D":
        return col(date)
    if freq in ("W", "M"):
        return F.trunc(col(date), {"W": "week", "M": "month"}[freq])
    raise ValueError(f"unknown frequency: {freq}")


def hotness(reads: Column | str, comments: Column | str) -> Column:
    return F.coalesce(col(reads), F.lit(0)) + 2 * F.coalesce(col(comments), F.lit(0))


def content_id(prefix: str, *parts: Column | str) -> Column:
    """Prefix and 16 hex digits of the md5 of the joined parts."""
    text = F.concat(*(F.coalesce(col(p), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.md5(text.cast("binary")), 1, 16))


def days_behind(date: Column | str, run_date: dt.date) -> Column:
    return F.datediff(F.lit(run_date), col(date))


def guarded_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation as an aggregate; null where either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def clamp(c: Column) -> Column:
    """Into 0 to 1; null stays null, which least and greatest alone would skip."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def by_code(order: str = "trade_date", code: str = "stock_code") -> WindowSpec:
    return Window.partitionBy(code).orderBy(order)


def rolling(n: int, order: str = "trade_date", code: str = "stock_code") -> WindowSpec:
    return by_code(order, code).rowsBetween(-(n - 1), 0)


def full_window(value: Column, count_of: Column | str, window: WindowSpec, n: int) -> Column:
    """``value`` where the frame holds ``n`` non-null observations, else null."""
    return F.when(F.count(count_of).over(window) == n, value)


def average_rank(value: Column | str, *by: str) -> Column:
    """Rank with ties averaged; rows must have non-null values."""
    least = F.rank().over(Window.partitionBy(*by).orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return least + (ties - 1) / 2
