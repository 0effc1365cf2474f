"""Factor computation: per-stock time-series windows and cross-sectional adjustments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.exprs import by_code, full_window, rolling
from quantloom.operators import scans

CODE, DATE = "stock_code", "trade_date"


def daily_return(price: str = "close") -> Column:
    """Change to the last known price before; a missing price counts as unchanged."""
    filled = F.last(price, ignorenulls=True).over(by_code().rowsBetween(Window.unboundedPreceding, 0))
    before = F.last(price, ignorenulls=True).over(by_code().rowsBetween(Window.unboundedPreceding, -1))
    return F.try_divide(filled, before) - 1


def momentum(df: DataFrame, periods: Sequence[int] = (5, 10, 20)) -> DataFrame:
    return df.withColumns({f"momentum_{p}": F.try_divide(F.col("close"), F.lag("close", p).over(by_code())) - 1 for p in periods})


def volatility(df: DataFrame, window: int = 20) -> DataFrame:
    return with_volatility(df.withColumn("_ret", daily_return()), window).drop("_ret")


def with_volatility(df: DataFrame, window: int) -> DataFrame:
    return df.withColumn("volatility", full_window(F.stddev_samp("_ret").over(rolling(window)), "_ret", rolling(window), window))


def turnover_adjusted(df: DataFrame, window: int = 5) -> DataFrame:
    if "turnover" not in df.columns:
        return df.withColumn("turnover_adj", F.lit(None).cast("double"))
    return df.withColumn("turnover_adj", full_window(F.avg("turnover").over(rolling(window)), "turnover", rolling(window), window))


def volume_price_trend(df: DataFrame) -> DataFrame:
    """Running sum of volume change times daily return, in stretches of days: a long history is many tasks.

    Of a stretch only the first row with a price depends on what is before it: the rows up to it have no return, those
    after it look back inside the stretch. So one summary of each stretch is enough for the whole scan.
    """
    known, before = (F.last("close", ignorenulls=True).over(scans.within().rowsBetween(Window.unboundedPreceding, k)) for k in (0, -1))
    rows = scans.stretched(df).withColumns({"_known": known, "_before": before, "_lag": F.lag("volume").over(scans.within()), "_place": F.row_number().over(scans.within())})
    first = F.col("close").isNotNull() & F.col("_before").isNull()
    rows = rows.withColumn("_in", F.coalesce((F.col("volume") - F.col("_lag")) * (F.try_divide("_known", "_before") - 1), F.lit(0.0)))
    summary = {
        "_last": scans.latest_in("close"), "_end": F.max_by("volume", DATE), "_sum_in": F.sum("_in"),
        "_first": F.min_by(F.struct("close", "volume", F.col("_lag").alias("lag"), F.col("_place").alias("place")), F.when(first, F.col(DATE))),
    }
    ends = {"_from": F.last("_last", ignorenulls=True).over(scans.earlier()), "_end_before": F.last("_end").over(scans.earlier())}
    earlier = F.when(F.col("_first.place") == 1, F.col("_end_before")).otherwise(F.col("_first.lag"))
    step = {"_at_first": F.coalesce((F.col("_first.volume") - earlier) * (F.try_divide("_first.close", "_from") - 1), F.lit(0.0))}
    carry = {"_step": F.col("_at_first"), "_base": F.sum(F.col("_sum_in") + F.col("_at_first")).over(scans.earlier())}
    rows = scans.with_carry(rows, summary, carry, ends, step)
    moved = F.col("_in") + F.when(first, F.col("_step")).otherwise(0.0)
    return rows.withColumn("vpt", F.sum(moved).over(scans.so_far()) + F.coalesce("_base", F.lit(0.0))).select(*df.columns, "vpt")


def with_volume_price_trend(df: DataFrame) -> DataFrame:
    moved = F.coalesce((F.col("volume") - F.lag("volume").over(by_code())) * F.col("_ret"), F.lit(0.0))
    running = by_code().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_m", moved).withColumn("vpt", F.sum("_m").over(running)).drop("_m")


def bollinger_bands(df: DataFrame, window: int = 20, width: float = 2.0) -> DataFrame:
    """Middle, upper and lower band, from one observation on; the deviation of one is null."""
    w = rolling(window)
    mid, dev = F.avg("close").over(w), F.stddev_samp("close").over(w)
    return df.withColumns({"bb_middle": mid, "bb_std": dev, "bb_upper": mid + width * dev, "bb_lower": mid - width * dev})


def bollinger_position(df: DataFrame, window: int = 20) -> DataFrame:
    w = rolling(window)
    mid, dev = F.avg("close").over(w), F.stddev_samp("close").over(w)
    place = F.try_divide(F.col("close") - (mid - 2 * dev), 4 * dev)
    return df.withColumn("bollinger_position", full_window(place, "close", w, window))


def average_true_range(df: DataFrame, window: int = 14) -> DataFrame:
    before = F.lag("close").over(by_code())
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    df = df.withColumn("_tr", true_range)
    return df.withColumn("atr", full_window(F.avg("_tr").over(rolling(window)), "_tr", rolling(window), window)).drop("_tr")


def industry_neutral(df: DataFrame, value: str, industry: str = "industry", by: Sequence[str] = ()) -> DataFrame:
    """Value minus its industry's mean (per date with ``by``); null without an industry."""
    means = df.groupBy(industry, *by).agg(F.avg(value).alias("_mean")).filter(F.col(industry).isNotNull())
    return df.join(means, [industry, *by], "left").withColumn(f"{value}_neutral", F.col(value) - F.col("_mean")).drop("_mean").select(*df.columns, f"{value}_neutral")


def cap_neutral(df: DataFrame, value: str, cap: str, by: Sequence[str] = (DATE,)) -> DataFrame:
    """Residual of the regression on log cap within each ``by``; with two valid rows or fewer the value itself."""
    df = df.withColumn("_x", F.when(F.col(cap) > 0, F.log(cap)))
    ok = F.col("_x").isNotNull() & F.col(value).isNotNull()
    x, y = F.when(ok, F.col("_x")), F.when(ok, F.col(value))
    fit = df.groupBy(*by).agg(F.count(x).alias("_n"), F.covar_pop(x, y).alias("_c"), F.var_pop(x).alias("_v"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    slope = F.coalesce(F.try_divide("_c", "_v"), F.lit(0.0))
    residual = F.col(value) - (F.col("_my") + slope * (F.col("_x") - F.col("_mx")))
    return df.join(fit, list(by)).withColumn(f"{value}_cap_neutral", F.when(F.col("_n") <= 2, F.col(value)).otherwise(residual)).drop("_x", "_n", "_c", "_v", "_mx", "_my")


def all_factors(df: DataFrame) -> DataFrame:
    """The common set; windows over one order share one sort, and the daily return is computed once."""
    df = momentum(df, (5, 20)).withColumn("_ret", daily_return())
    return average_true_range(with_volume_price_trend(bollinger_position(with_volatility(df, 20)))).drop("_ret")


def moving_averages(df: DataFrame, windows: Sequence[int] = (5, 20)) -> DataFrame:
    return df.withColumns({f"ma_{n}": F.avg("close").over(rolling(n)) for n in windows})


def relative_strength(df: DataFrame, window: int = 14) -> DataFrame:
    """From the first row on, over as many rows as there are; the first row has no change and so 0."""
    delta = F.col("close") - F.lag("close").over(by_code())
    df = df.withColumns({"_up": F.greatest(F.coalesce(delta, F.lit(0.0)), F.lit(0.0)), "_down": F.greatest(F.coalesce(-delta, F.lit(0.0)), F.lit(0.0))})
    w = rolling(window)
    ratio = F.avg("_up").over(w) / (F.avg("_down").over(w) + 1e-10)
    return df.withColumn("rsi", 100 - 100 / (1 + ratio)).drop("_up", "_down")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Difference of two exponentially weighted means (adjusted weights), its own such mean, and what is between them."""
    df = df.drop("macd", "macd_signal", "macd_hist")
    rows = scans.with_weighted_means(scans.stretched(df), "close", {"_fast": fast, "_slow": slow})
    rows = scans.with_weighted_means(rows.withColumn("macd", F.col("_fast") - F.col("_slow")), "macd", {"macd_signal": signal})
    return rows.select(*df.columns, "macd", "macd_signal", (F.col("macd") - F.col("macd_signal")).alias("macd_hist"))


def period_end(date: str, freq: str) -> Column:
    if freq == "W":
        return F.date_add(F.trunc(date, "week"), 6)
    if freq == "M":
        return F.last_day(date)
    if freq == "Q":
        return F.last_day(F.add_months(F.trunc(date, "quarter"), 2))
    raise ValueError(f"unknown frequency: {freq}")


#: Aggregates of the close of a period.
CLOSES = {"last": lambda: F.max_by("close", DATE), "first": lambda: F.min_by("close", DATE), "mean": lambda: F.avg("close"), "max": lambda: F.max("close"), "min": lambda: F.min("close"), "sum": lambda: F.sum("close")}


def resampled(df: DataFrame, freq: str, empty: bool = False, close: str = "last") -> DataFrame:
    """Bars of a week, month or quarter, named by its last day; ``empty`` adds periods without rows (null prices, zero sums), ``close`` names its aggregate."""
    if close not in CLOSES:
        raise ValueError(f"unknown aggregate: {close}")
    out = df.groupBy(CODE, period_end(DATE, freq).alias("period_end")).agg(
        F.min_by("open", DATE).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), CLOSES[close]().alias("close"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount")
    )
    if not empty:
        return out
    step = {"W": "interval 7 day", "M": "interval 1 month", "Q": "interval 3 month"}[freq]
    span = out.groupBy(CODE).agg(F.min("period_end").alias("a"), F.max("period_end").alias("b"))
    starts = F.sequence("a", F.date_add("b", 3), F.expr(step))
    periods = span.select(CODE, F.explode(starts).alias("d")).select(CODE, F.col("d").alias("period_end") if freq == "W" else F.last_day("d").alias("period_end")).join(span.select(CODE, "b"), CODE).filter("period_end <= b").drop("b")
    return periods.distinct().join(out, [CODE, "period_end"], "left").fillna(0, ["volume", "amount"])


def filled_calendar(df: DataFrame, columns: Sequence[str] = ("close",)) -> DataFrame:
    """Every calendar day between the first and last date of all, for each stock, carried forward; leading gaps stay null."""
    span = df.agg(F.min(DATE).alias("a"), F.max(DATE).alias("b"))
    stretches = F.sequence(*(F.floor(F.datediff(x, F.lit("1970-01-01")) / scans.DAYS) for x in ("a", "b")))
    dealt = df.select(CODE).distinct().join(F.broadcast(span)).select(CODE, "a", "b", F.explode(stretches).alias(scans.STRETCH)).repartition(CODE, scans.STRETCH)  # span is one row
    at = (F.col(scans.STRETCH) * scans.DAYS).cast("int")
    day = lambda n: F.date_add(F.lit("1970-01-01").cast("date"), n)
    # a row a stock and stretch is shuffled; its days are made where it lies
    grid = dealt.select(CODE, scans.STRETCH, F.explode(F.sequence(F.greatest("a", day(at)), F.least("b", day(at + scans.DAYS - 1)))).alias(DATE))
    rows = scans.stretched(df.select(CODE, DATE, *columns))
    joined = grid.join(rows, [CODE, scans.STRETCH, DATE], "left")
    return scans.with_last_known(joined, columns).select(CODE, DATE, *(F.col(f"{c}_known").alias(c) for c in columns))


def wide(df: DataFrame, value: str, codes: Sequence[str]) -> DataFrame:
    return df.filter(F.col(CODE).isin(list(codes))).groupBy(DATE).pivot(CODE, list(codes)).agg(F.first(value))


def long(df: DataFrame, value: str) -> DataFrame:
    return df.unpivot([DATE], [c for c in df.columns if c != DATE], CODE, value).filter(F.col(value).isNotNull())
