"""News and report sentiment."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.exprs import bucket, hotness
from quantloom.functions.predicates import between


def stock_news(news: DataFrame, code: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    rows = between(news, start, end, "publish_date").filter(F.array_contains("related_stocks", code))
    return rows.orderBy(F.desc("publish_date"), "news_id")


def aggregated(news: DataFrame, codes: Sequence[str] = (), start: dt.date | None = None, end: dt.date | None = None, freq: str = "D") -> DataFrame:
    """Per bucket; a row counts once even if several codes match."""
    rows = between(news, start, end, "publish_date")
    if codes:
        rows = rows.filter(F.arrays_overlap("related_stocks", F.array(*map(F.lit, codes))))
    n = lambda label: F.count(F.when(F.col("sentiment_label") == label, 1)).alias(f"n_{label}")
    return rows.groupBy(bucket("publish_date", freq).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("sentiment_score").alias("mean"), F.stddev_samp("sentiment_score").alias("std"), n("positive"), n("negative"), n("neutral")
    )


def report_sentiment(reports: DataFrame, code: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    return between(reports, start, end, "publish_date").filter(F.col("related_stock") == code).orderBy(F.desc("publish_date"), "report_id")


def sentiment_stocks(news: DataFrame, label: str, date: dt.date | None = None, limit: int | None = 20) -> DataFrame:
    """Stocks of a day's news with a label, highest mean score first; by default the last day of all news, with the label or not."""
    rows = news.filter(F.col("sentiment_label") == label)
    if date is None:
        last = news.agg(F.max("publish_date").alias("_last"))
        rows = rows.join(F.broadcast(last), F.col("publish_date") == F.col("_last"))  # one row
    else:
        rows = between(rows, date, date, "publish_date")
    scores = rows.select("sentiment_score", F.explode("related_stocks").alias("stock_code")).groupBy("stock_code").agg(F.avg("sentiment_score").alias("mean"), F.count(F.lit(1)).alias("n"))
    scores = scores.orderBy(F.desc("mean"), "stock_code")
    return scores if limit is None else scores.limit(limit)


def trend(news: DataFrame, window: int = 5, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Daily mean and its moving mean, for every stock."""
    rows = between(news, start, end, "publish_date").select("publish_date", "sentiment_score", F.explode("related_stocks").alias("stock_code"))
    daily = rows.groupBy("stock_code", "publish_date").agg(F.avg("sentiment_score").alias("mean"))
    return daily.withColumn("moving", F.avg("mean").over(Window.partitionBy("stock_code").orderBy("publish_date").rowsBetween(-(window - 1), 0)))


def hot_news(news: DataFrame, date: dt.date, limit: int = 20) -> DataFrame:
    rows = between(news, date, date, "publish_date").withColumn("hot", hotness("read_count", "comment_count"))
    return rows.orderBy(F.desc("hot"), "news_id").limit(limit)


def sentiment_factor(news: DataFrame, window: int = 5) -> DataFrame:
    """Daily mean over all news, its moving mean, and the change from the day before."""
    order = Window.orderBy("bucket")  # a row per day
    daily = aggregated(news).select("bucket", "mean", "n")
    return daily.withColumn("moving", F.avg("mean").over(order.rowsBetween(-(window - 1), 0))).withColumn("change", F.col("mean") - F.lag("mean").over(order))


def sentiment_signals(news: DataFrame, label: str, date: dt.date, least: int = 2, top: int = 10) -> DataFrame:
    """The limit to twice ``top`` comes before the filter on the number of news."""
    first = sentiment_stocks(news, label, date, 2 * top).filter(F.col("n") >= least)
    return first.orderBy(F.asc("mean") if label == "negative" else F.desc("mean"), "stock_code").limit(top)


def event_study(news: DataFrame, code: str, event: dt.date, days: int = 10) -> DataFrame:
    """Mean score before and on or after a day, within ``days`` of it, and the change."""
    near = between(news, event - dt.timedelta(days), event + dt.timedelta(days), "publish_date").filter(F.array_contains("related_stocks", code))
    before = F.col("publish_date") < F.lit(event)
    means = near.agg(F.avg(F.when(before, F.col("sentiment_score"))).alias("before"), F.avg(F.when(~before, F.col("sentiment_score"))).alias("after"), F.count(F.lit(1)).alias("n"))
    return means.withColumn("change", F.col("after") - F.col("before"))
