"""Streaming forms of the intraday and news feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.sources.sinks import one_of_each


def minute_bars(ticks: DataFrame, minutes: int = 1, late: str = "10 minutes") -> DataFrame:
    """Bars and VWAP per stock and window of event time ``ts``; works on streams and on tables."""
    rows = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    bars = rows.groupBy("stock_code", F.window("ts", f"{minutes} minutes").alias("w")).agg(
        F.min_by("px", F.struct("ts", "event_id")).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", F.struct("ts", "event_id")).alias("close"),
        F.sum("volume").alias("volume"), F.try_divide(F.sum(F.col("px") * F.col("volume")), F.sum("volume")).alias("vwap"),
    )
    return bars.select("stock_code", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume", "vwap")


def sliding_sentiment(news: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    rows = news.withWatermark("ts", late) if news.isStreaming else news
    each = rows.select("ts", "sentiment_score", F.explode("related_stocks").alias("stock_code"))
    out = each.groupBy("stock_code", F.window("ts", width, step).alias("w")).agg(F.avg("sentiment_score").alias("mean"), F.count(F.lit(1)).alias("n"))
    return out.select("stock_code", F.col("w.start").alias("start"), "mean", "n")


def news_bursts(news: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    rows = news.withWatermark("ts", late) if news.isStreaming else news
    each = rows.select("ts", F.explode("related_stocks").alias("stock_code"))
    out = each.groupBy("stock_code", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("stock_code", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_only(rows: DataFrame, key: str = "news_id", late: str = "1 hour") -> DataFrame:
    """The first row of each key: as it arrives in a stream, by time (then by the other columns) in a table."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if rows.isStreaming else one_of_each(rows, [key], False, "ts")


def land_by_date(ticks: DataFrame, path: str, checkpoint: str):
    """Start a stream that writes ticks to Parquet partitioned by date; a batch that runs again replaces its own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch", F.lit(batch_id)).withColumn("trade_date", F.to_date("ts"))
        rows.repartition("trade_date").sortWithinPartitions("stock_code").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trade_date", "batch").parquet(path)

    return ticks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
