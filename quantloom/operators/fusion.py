"""Multi-source analytics: one plan for all stocks, scores as Columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.exprs import average_rank, clamp, guarded_corr
from quantloom.functions.predicates import between

#: Default weights of the five scores.
WEIGHTS = {"factor": 0.30, "sentiment": 0.20, "macro": 0.20, "alternative": 0.15, "price": 0.15}


def macro_factor_pairs(macro: DataFrame, factors: DataFrame) -> DataFrame:
    """(indicator_id, factor_name, trade_date, x, y): indicators beside the factors' daily means (rounded, so that ties do not hang on the order of a sum)."""
    daily = factors.groupBy("factor_name", "trade_date").agg(F.round(F.avg("factor_value"), 12).alias("y"))
    return macro.filter("value_type = 'raw'").select("indicator_id", "trade_date", F.col("value").alias("x")).join(daily, "trade_date")


def macro_factor_correlation(macro: DataFrame, factors: DataFrame, method: str = "pearson") -> DataFrame:
    """Every indicator with every factor in one job; under three common dates: 0."""
    pairs = macro_factor_pairs(macro, factors).filter("x is not null and y is not null")
    if method == "spearman":
        by = ("indicator_id", "factor_name")
        pairs = pairs.select(*by, average_rank("x", *by).alias("x"), average_rank("y", *by).alias("y"))
    elif method != "pearson":
        raise ValueError(f"unknown method: {method}")
    out = pairs.groupBy("indicator_id", "factor_name").agg(F.count(F.lit(1)).alias("n"), guarded_corr("x", "y").alias("corr"))
    return out.withColumn("corr", F.when(F.col("n") < 3, 0.0).otherwise(F.col("corr")))


def z_scores(macro: DataFrame, ids: list[str], lookback: int) -> DataFrame:
    """(trade_date, one column for each indicator): carried forward, rolling z-score; incomplete dates do not appear."""
    grid = macro.filter("value_type = 'raw'").groupBy("trade_date").pivot("indicator_id", ids).agg(F.first("value"))
    order = Window.orderBy("trade_date")  # a row per date
    grid = grid.select("trade_date", *(F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in ids))
    w = order.rowsBetween(-(lookback - 1), 0)
    z = [F.when(F.count(c).over(w) == lookback, F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w))).alias(c) for c in ids]
    return grid.select("trade_date", *z).dropna()


def macro_factor(macro: DataFrame, ids: list[str], lookback: int = 20) -> DataFrame:
    total = sum((F.col(c) for c in ids[1:]), F.col(ids[0]))
    return z_scores(macro, ids, lookback).select("trade_date", (total / len(ids)).alias("macro_factor"))


def macro_factor_pca(macro: DataFrame, ids: list[str], lookback: int = 20) -> DataFrame:
    """First principal component of the centred z-scores; its largest loading is positive."""
    z = z_scores(macro, ids, lookback)  # a row a date, computed again rather than kept
    means = z.agg(*(F.avg(c).alias(c) for c in ids)).first()  # one row
    if means[0] is None:
        return z.select("trade_date", F.lit(None).cast("double").alias("macro_factor"))
    centred = z.select("trade_date", *((F.col(c) - means[c]).alias(c) for c in ids))
    vectors = VectorAssembler(inputCols=ids, outputCol="v").transform(centred)
    model = PCA(k=1, inputCol="v", outputCol="p").fit(vectors)
    loadings = model.pc.toArray()[:, 0]
    sign = 1.0 if loadings[abs(loadings).argmax()] >= 0 else -1.0
    return model.transform(vectors).select("trade_date", (vector_to_array("p")[0] * sign).alias("macro_factor"))


def sector_sensitivity(prices: DataFrame, info: DataFrame, macro: DataFrame, indicator: str) -> DataFrame:
    """Slope of each industry's monthly mean return on the indicator's change."""
    month = F.trunc("trade_date", "month")
    monthly = prices.groupBy("stock_code", month.alias("trade_date")).agg(F.max_by("close", "trade_date").alias("close"))
    moves = monthly.withColumn("r", F.try_divide("close", F.lag("close").over(Window.partitionBy("stock_code").orderBy("trade_date"))) - 1)
    sectors = moves.join(info.select("stock_code", "industry"), "stock_code").groupBy("industry", "trade_date").agg(F.avg("r").alias("r"))
    series = macro.filter((F.col("indicator_id") == indicator) & (F.col("value_type") == "raw"))
    change = series.select("trade_date", (F.col("value") - F.lag("value").over(Window.partitionBy("indicator_id").orderBy("trade_date"))).alias("d"))
    both = sectors.join(change, "trade_date").filter("r is not null and d is not null")
    return both.groupBy("industry").agg(F.try_divide(F.covar_pop("r", "d"), F.var_pop("d")).alias("slope"), F.count(F.lit(1)).alias("n"))


def factor_score(pe: DataFrame) -> DataFrame:
    """One minus the percentile rank of the PE among ``pe(stock_code, factor_value)``."""
    rows = pe.filter(F.col("factor_value").isNotNull())
    rows = rows.withColumn("_r", average_rank("factor_value")).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    return rows.select("stock_code", (1 - F.col("_r") / F.col("_n")).alias("factor_score"))


def sentiment_score(news: DataFrame) -> DataFrame:
    each = news.select("sentiment_score", F.explode(F.array_distinct("related_stocks")).alias("stock_code"))
    return each.groupBy("stock_code").agg(((F.avg("sentiment_score") + 1) / 2).alias("sentiment_score"))


def macro_score(macro: DataFrame, date: dt.date) -> DataFrame:
    pmi = macro.filter((F.col("indicator_id") == "PMI") & (F.col("value_type") == "raw") & (F.col("trade_date") == F.lit(date)))
    return pmi.agg(clamp(0.5 + (F.first("value") - 50) / 20).alias("macro_score"))


def alternative_score(data: DataFrame, date: dt.date) -> DataFrame:
    rows = data.filter((F.col("data_type") == "chain") & (F.col("trade_date") == F.lit(date)))
    return rows.groupBy(F.col("entity_id").alias("entity")).agg(clamp((F.min_by("value", "data_id") - 3000) / 1000).alias("alternative_score"))


def price_score(prices: DataFrame, date: dt.date, days: int = 20) -> DataFrame:
    near = between(prices, date - dt.timedelta(days), date)
    change = F.try_divide(F.max_by("close", "trade_date"), F.min_by("close", "trade_date")) - 1
    return near.groupBy("stock_code").agg(F.count(F.lit(1)).alias("_n"), clamp(0.5 + 10 * change).alias("price_score")).filter("_n >= 5").drop("_n")


def combined_score(stocks: DataFrame, date: dt.date, pe: DataFrame, news: DataFrame, macro: DataFrame, data: DataFrame, prices: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Weighted sum of the five scores for ``stocks(stock_code)``; a missing score is 0.5, one of weight zero null.

    pe(stock_code, factor_value) and news are those of the date.
    """
    out = stocks.select("stock_code").join(factor_score(pe), "stock_code", "left").join(sentiment_score(news), "stock_code", "left")
    out = out.join(F.broadcast(macro_score(macro, date)))  # one row
    out = out.withColumn("entity", F.substring("stock_code", 1, 2)).join(alternative_score(data, date), "entity", "left").drop("entity")
    out = out.join(price_score(prices, date), "stock_code", "left")
    scores = {k: F.coalesce(F.col(f"{k}_score"), F.lit(0.5)) for k in WEIGHTS}
    total = sum((scores[k] * float(weights.get(k, 0.0)) for k in WEIGHTS), F.lit(0.0))
    shown = [(scores[k] if weights.get(k) else F.lit(None).cast("double")).alias(f"{k}_score") for k in WEIGHTS]
    return out.select("stock_code", *shown, total.alias("total_score"))


def best_stocks(scores: DataFrame, least: float = 0.6, top: int = 50) -> DataFrame:
    return scores.filter(F.col("total_score") >= least).orderBy(F.desc("total_score"), "stock_code").limit(top)


def source_panel(stocks: DataFrame, date: dt.date, pe: DataFrame, news: DataFrame, prices: DataFrame) -> DataFrame:
    """Close, PE, mean sentiment and number of news of each stock on the date."""
    each = news.select("sentiment_score", F.explode(F.array_distinct("related_stocks")).alias("stock_code"))
    mood = each.groupBy("stock_code").agg(F.avg("sentiment_score").alias("sentiment"), F.count(F.lit(1)).alias("n_news"))
    close = between(prices, date, date).select("stock_code", "close")
    out = stocks.select("stock_code").join(close, "stock_code", "left").join(pe.select("stock_code", F.col("factor_value").alias("pe")), "stock_code", "left")
    return out.join(mood, "stock_code", "left").withColumn("n_news", F.coalesce("n_news", F.lit(0).cast("long")))
