"""Data-quality checks: one aggregate of conditional counts each, as rows (check, severity, n)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.exprs import market_of


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def violations(df: DataFrame, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """A row for each rule (name, severity, condition) with how many rows meet the condition."""
    counts = df.agg(*(F.count(F.when(c, 1)).alias(n) for n, _, c in rules), F.count(F.lit(1)).alias("_rows"))
    rows = F.array(*(F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), F.col(n).alias("n")) for n, s, _ in rules))
    return counts.select(F.inline(rows), ) if rules else counts.select(F.lit("").alias("check"), F.lit("").alias("severity"), F.lit(0).alias("n")).limit(0)


def null_share(df: DataFrame, columns: Sequence[str], limit: float) -> DataFrame:
    """(column, share, over): share of nulls of each column and whether it is above ``limit``."""
    shares = df.agg(*(F.try_divide(F.count(F.when(F.col(c).isNull(), 1)).cast("double"), F.count(F.lit(1))).alias(c) for c in columns))
    return shares.unpivot([], list(columns), "column", "share").withColumn("over", F.coalesce(F.col("share") > limit, F.lit(False)))


def price_checks(df: DataFrame) -> DataFrame:
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return violations(df, [
        ("high_below_others", "warning", (h < low) | (h < o) | (h < c)),
        ("low_above_others", "warning", (low > o) | (low > c)),
        ("negative_price", "error", (o < 0) | (h < 0) | (low < 0) | (c < 0)),
        ("negative_volume", "error", F.col("volume") < 0),
    ])


def factor_checks(df: DataFrame) -> DataFrame:
    return violations(df, [
        ("empty_name", "error", F.col("factor_name").isNull() | (F.trim("factor_name") == "")),
        ("infinite_value", "error", F.abs("factor_value") == float("inf")),
        ("not_a_number", "error", F.isnan("factor_value")),
    ])


def level1_checks(df: DataFrame, time: str = "time_int") -> DataFrame:
    t = F.lpad(F.col(time).cast("string"), 6, "0")
    return violations(df, [
        ("bad_time", "error", ~F.coalesce(t.rlike(r"^([01]\d|2[0-3])[0-5]\d[0-5]\d$"), F.lit(False))),
        ("negative_price", "error", F.col("px") < 0),
        ("no_volume", "warning", F.coalesce(F.col("volume"), F.lit(0)) <= 0),
    ])


def code_checks(df: DataFrame, column: str = "stock_code") -> DataFrame:
    c = F.col(column)
    return violations(df, [
        ("bad_code", "error", ~F.coalesce(c.rlike(r"^\d{6}(\.(SH|SZ|BJ))?$"), F.lit(False))),
        ("wrong_exchange", "warning", c.rlike(r"^\d{6}\.") & (F.substring_index(c, ".", -1) != market_of(F.substring(c, 1, 6)))),
    ])
