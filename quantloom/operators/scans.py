"""Recurrences along a stock's history as two-level scans, so that one long history spreads over tasks.

A running sum, the last known value and an exponentially weighted mean compose: what a stretch of
rows does to the state before it is a small summary (a sum, a value, an affine map). Rows are dealt by stock and stretch of
calendar days, summed up to one row a stretch, the summaries are scanned along each stock, and every stretch
starts from what the earlier ones come to. No stock is ever one task, and all of it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

CODE, DATE, STRETCH = "stock_code", "trade_date", "_stretch"
#: Calendar days of a stretch; weights are powers of a row's place in it, so that they stay far from overflow.
DAYS = 256


def stretched(df: DataFrame, days: int = DAYS) -> DataFrame:
    """``df`` dealt by stock and stretch of days."""
    return df.withColumn(STRETCH, F.floor(F.datediff(DATE, F.lit("1970-01-01")) / days)).repartition(CODE, STRETCH)


def within() -> WindowSpec:
    return Window.partitionBy(CODE, STRETCH).orderBy(DATE)


def so_far() -> WindowSpec:
    return within().rowsBetween(Window.unboundedPreceding, 0)


def earlier() -> WindowSpec:
    """The summaries of a stock's earlier stretches, a row each."""
    return Window.partitionBy(CODE).orderBy(STRETCH).rowsBetween(Window.unboundedPreceding, -1)


def with_carry(rows: DataFrame, summary: Mapping[str, Column], carry: Mapping[str, Column], *before: Mapping[str, Column]) -> DataFrame:
    """``rows`` of ``stretched`` with columns ``carry``, windows over ``earlier()`` of the stretches' aggregates ``summary``.

    What ``carry`` needs besides is computed ``before``, step by step, a row a stretch.
    """
    parts = rows.groupBy(CODE, STRETCH).agg(*(c.alias(k) for k, c in summary.items()))
    for step in before:
        parts = parts.withColumns(step)
    parts = parts.select(F.col(CODE).alias("_code"), F.col(STRETCH).alias("_at"), *(c.alias(k) for k, c in carry.items()))
    return rows.join(parts, F.col(CODE).eqNullSafe(F.col("_code")) & (F.col(STRETCH) == F.col("_at")), "left").drop("_code", "_at")


def latest_in(value: str) -> Column:
    """The last known value of a stretch."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(DATE)))


def with_last_known(rows: DataFrame, values: Sequence[str], before: bool = False) -> DataFrame:
    """Columns ``<value>_known``: the last known value up to each row, or up to the row ``before``."""
    summary = {f"_last_{v}": latest_in(v) for v in values}
    rows = with_carry(rows, summary, {f"_from_{v}": F.last(f"_last_{v}", ignorenulls=True).over(earlier()) for v in values})
    frame = within().rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    known = {f"{v}_known": F.coalesce(F.last(v, ignorenulls=True).over(frame), f"_from_{v}") for v in values}
    return rows.withColumns(known).drop(*(f"_from_{v}" for v in values))


def with_running_sum(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Column ``name``: the sum of ``value`` up to each row."""
    rows = with_carry(rows, {"_sum": F.sum(value)}, {"_before": F.sum("_sum").over(earlier())})
    return rows.withColumn(name, F.sum(value).over(so_far()) + F.coalesce("_before", F.lit(0.0))).drop("_before")


def decayed(keep: float, sums: str, weights: str) -> Callable[[Column, Column], Column]:
    """The affine map of one stretch: its rows' weighted sums are added, and its length decays all."""

    def step(state: Column, part: Column) -> Column:
        decay = F.pow(F.lit(keep), part["_rows"])
        return F.struct((decay * (state["n"] + part[sums])).alias("n"), (decay * (state["d"] + part[weights])).alias("d"))

    return step


def with_weighted_means(rows: DataFrame, value: str, spans: Mapping[str, int]) -> DataFrame:
    """Columns ``spans``: exponentially weighted means with adjusted weights, by span; a null row decays the others and keeps the mean.

    With k the decay, a row at place p of its stretch has numerator k^p (N + sum of k^-i x_i) and denominator
    k^p (D + sum of k^-i), where N and D are the state before the stretch; k^p cancels.
    """
    rows = rows.withColumn("_place", F.row_number().over(within()))
    known = F.col(value).isNotNull()
    summary, carry, means = {"_rows": F.count(F.lit(1)).cast("double")}, {}, {}
    for name, span in spans.items():
        keep = 1 - 2 / (span + 1)
        weight = F.when(known, F.pow(F.lit(keep), -F.col("_place")))
        sums, weights = f"_sums_{name}", f"_weights_{name}"
        summary |= {sums: F.coalesce(F.sum(F.col(value) * weight), F.lit(0.0)), weights: F.coalesce(F.sum(weight), F.lit(0.0))}
        stretches = F.collect_list(F.struct("_rows", sums, weights)).over(earlier())
        start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))

        carry[f"_state_{name}"] = F.aggregate(stretches, start, decayed(keep, sums, weights))
        state = F.col(f"_state_{name}")
        top = F.coalesce(F.sum(F.col(value) * weight).over(so_far()), F.lit(0.0)) + F.coalesce(state["n"], F.lit(0.0))
        means[name] = F.try_divide(top, F.coalesce(F.sum(weight).over(so_far()), F.lit(0.0)) + F.coalesce(state["d"], F.lit(0.0)))
    rows = with_carry(rows, summary, carry)
    return rows.withColumns(means).drop("_place", *carry)
