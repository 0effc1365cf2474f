"""Filters shared by all query operators, compiled to Columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lists beyond this many values are joined instead of inlined.
INLINE = 1000


def between(df: DataFrame, start: dt.date | None = None, end: dt.date | None = None, date: str = "trade_date") -> DataFrame:
    """Rows from ``start`` to ``end``, both included; an absent bound does not filter."""
    if start is not None:
        df = df.filter(F.col(date) >= F.lit(start))
    return df if end is None else df.filter(F.col(date) <= F.lit(end))


def members(df: DataFrame, values: Sequence[str] | None, column: str = "stock_code") -> DataFrame:
    """Rows whose ``column`` is in ``values``; an empty list does not filter."""
    if not values:
        return df
    if len(values) <= INLINE:
        return df.filter(F.col(column).isin(list(values)))
    listed = df.sparkSession.createDataFrame([(v,) for v in set(values)], f"{column} string")
    return df.join(listed, column, "left_semi")


def projected(df: DataFrame, fields: Sequence[str] | None, default: Sequence[str]) -> DataFrame:
    return df.select(*(fields or default))


@dataclass(frozen=True)
class QueryFilter:
    """Dates, codes, fields and as-of time of a query."""

    start: dt.date | None = None
    end: dt.date | None = None
    codes: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    as_of: str | None = None
    date: str = "trade_date"

    def rows(self, df: DataFrame) -> DataFrame:
        return members(between(df, self.start, self.end, self.date), self.codes)

    def apply(self, df: DataFrame, default: Sequence[str]) -> DataFrame:
        return projected(self.rows(df), self.fields, default)
