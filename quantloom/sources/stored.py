"""Tables that stay in place: partitions are rewritten only where something changes, and every write can be run again.

What replaces partitions is staged in a folder of its own first, as it is computed from the files that it
replaces; then a dynamic partition overwrite swaps in just the partitions that were staged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quantloom.operators.pit import KEY, compacted
from quantloom.sources.sinks import scratch, with_column_upserted

HISTORY = "trade_date date, stock_code string, factor_value double, loaded_at timestamp, factor_name string, load string"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def with_month(df: DataFrame, date: str = "trade_date") -> DataFrame:
    """``df`` with the first day of the month, to partition by: a folder a month rather than a day."""
    return df.withColumn("month", F.trunc(date, "month"))


def replaced_partitions(df: DataFrame, path: str, by: Sequence[str], sort_by: Sequence[str] = KEY) -> DataFrame:
    """Put ``df`` in the place of the partitions of ``path`` that it has rows of, and return it as staged; others keep their files."""
    spark, stage = df.sparkSession, f"{scratch(df.sparkSession)}/stage"
    df.repartition(*by).sortWithinPartitions(*by, *sort_by).write.partitionBy(*by).parquet(stage)
    staged = spark.read.schema(df.schema).parquet(stage)
    # staged files lie by partition and sorted: each split is put in place as it is read, without a second shuffle
    staged.sortWithinPartitions(*by, *sort_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return staged


def compact_table(spark: SparkSession, path: str, keep_before: str, by: Sequence[str] = ("month",), key: Sequence[str] = KEY, version: str = "loaded_at") -> DataFrame:
    """Drop from a stored table the versions that ``pit.compacted`` drops; (by, n_kept, n_dropped) of the partitions rewritten.

    Partitions without such versions are not touched. Rows are counted while they are read and written, and
    the counts must agree with what was staged. Run again, it finds nothing to do.
    """
    table = spark.read.parquet(path)
    old = table.filter(F.col(version) < F.lit(keep_before).cast("timestamp"))
    several = old.groupBy(*dict.fromkeys([*by, *key])).agg(F.min(version).alias("a"), F.max(version).alias("b")).filter("a < b")
    report = f"{scratch(spark)}/before"
    touched = several.select(*by).distinct()
    rows = table.join(F.broadcast(touched), list(by), "left_semi")  # a row a partition
    rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_before")).write.parquet(report)
    before = spark.read.parquet(report)
    if before.isEmpty():
        return before.select(*by, F.lit(0).cast("long").alias("n_kept"), F.lit(0).cast("long").alias("n_dropped"))
    seen, kept = Observation(), Observation()
    pruned = table.join(F.broadcast(before.filter("n_before > 0").select(*by)), list(by), "left_semi").observe(seen, F.count(F.lit(1)).alias("n"))
    staged = replaced_partitions(compacted(pruned, keep_before, key, version).observe(kept, F.count(F.lit(1)).alias("n")), path, by, key)
    out = before.join(staged.groupBy(*by).agg(F.count(F.lit(1)).alias("n_kept")), list(by), "left").select(*by, F.coalesce("n_kept", F.lit(0)).alias("n_kept"), "n_before")
    total = out.agg(F.sum("n_kept"), F.sum("n_before")).first()
    if (kept.get["n"], seen.get["n"]) != tuple(total):
        raise RuntimeError(f"counted {seen.get['n']} rows and kept {kept.get['n']}, but {total[1]} and {total[0]} are stored")
    return out.select(*by, "n_kept", (F.col("n_before") - F.col("n_kept")).alias("n_dropped"))


def delete_factors(spark: SparkSession, path: str, names: Sequence[str], by: Sequence[str] = ("month",)) -> DataFrame:
    """Take mis-routed factors out of a stored long table; (by, n_deleted) of the partitions that held them, the only ones rewritten.

    A partition that holds nothing else goes with its folder. Run again, it finds nothing to do.
    """
    table = spark.read.parquet(path)
    wrong = F.coalesce(F.col("factor_name").isin(list(names)), F.lit(False))
    report = f"{scratch(spark)}/deleted"
    table.filter(wrong).groupBy(*by).agg(F.count(F.lit(1)).alias("n_deleted")).write.parquet(report)
    deleted = spark.read.parquet(report)
    if deleted.isEmpty():
        return deleted
    rows = table.join(F.broadcast(deleted.filter("n_deleted > 0").select(*by)), list(by), "left_semi").filter(~wrong)
    staged = replaced_partitions(rows, path, by)
    for part in deleted.join(staged.select(*by).distinct(), list(by), "left_anti").select(*by).collect():  # partitions of nothing else
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/" + "/".join(f"{c}={part[c]}" for c in by))
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return deleted


def store_factor(spark: SparkSession, root: str, new: DataFrame, name: str, loaded_at: str) -> None:
    """Write ``new(trade_date, stock_code, factor_value)`` to the history and into the column ``name`` of the wide table under ``root``.

    The history gains one load, a partition by factor and load time, so the same load again replaces itself.
    In the wide table only the months of ``new`` are merged and rewritten; a new column leaves the files of other
    months as they are. Null values do not overwrite; of a repeated key the greatest value counts.
    """
    rows = new.filter(F.col("factor_value").isNotNull()).groupBy("trade_date", "stock_code").agg(F.max(F.col("factor_value").cast("double")).alias("factor_value"))
    at = F.lit(loaded_at).cast("timestamp")
    load = F.date_format(at, "'l'yyyyMMddHHmmss")
    history = rows.withColumns({"loaded_at": at, "factor_name": F.lit(name), "load": load})
    history.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("factor_name", "load").parquet(f"{root}/history")
    path = f"{root}/wide"
    if exists(spark, path):
        months = with_month(rows).select("month").filter(F.col("month") >= F.lit("0001-01-01").cast("date")).distinct()  # the comparison lets Catalyst prune by it
        old = stored_wide(spark, root).join(F.broadcast(months), "month", "left_semi")  # a row a month: prunes partitions as it runs
    else:
        old = with_month(rows).limit(0).select("trade_date", "stock_code", "month")
    merged = with_month(with_column_upserted(old.drop("month"), rows, name))
    replaced_partitions(merged, path, ["month"])


def stored_wide(spark: SparkSession, root: str) -> DataFrame:
    """The wide table with every factor column that any month has."""
    return spark.read.option("mergeSchema", "true").parquet(f"{root}/wide")


def stored_history(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(HISTORY).parquet(f"{root}/history").drop("load")


# --- bars kept as partial aggregates -----------------------------------------------------------------------------


def partial_bars(ticks: DataFrame, minutes: int = 1) -> DataFrame:
    """Ticks as partial bars: what merges again, whatever the order (ordered ends, extremes, sums)."""
    order = F.struct("trade_sec", "event_id") if "event_id" in ticks.columns else F.struct("trade_sec")
    slot = F.col("trade_sec") - F.col("trade_sec") % (60 * minutes)
    return ticks.groupBy("stock_code", "trade_date", slot.alias("bar_sec")).agg(
        F.min(F.struct(order.alias("at"), "open")).alias("first"), F.max(F.struct(order.alias("at"), "close")).alias("last"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.sum("volume").alias("volume"), F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n_ticks"),
    )


def merged_bars(partials: DataFrame, minutes: int | None = None) -> DataFrame:
    """Bars of so many minutes, or of the day, from partial bars of any width that divides them."""
    keys = ["stock_code", "trade_date"]
    if minutes is not None:
        partials = partials.withColumn("bar_sec", F.col("bar_sec") - F.col("bar_sec") % (60 * minutes))
        keys.append("bar_sec")
    out = partials.groupBy(*keys).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount"), F.sum("n_ticks").alias("n_ticks"))
    return out.select(*keys, F.col("first.open").alias("open"), "high", "low", F.col("last.close").alias("close"), "volume", "amount", F.try_divide("amount", "volume").alias("vwap"), "n_ticks")


def store_partials(ticks: DataFrame, root: str, batch: str, minutes: int = 1) -> None:
    """Add a batch of ticks to the stored partials as rows of its own; a day's ticks are read once, late ones alone.

    A batch is a partition by date and batch name: stored again it replaces itself, and no other batch is read.
    """
    rows = partial_bars(ticks, minutes).withColumn("batch", F.lit(f"b-{batch}"))
    rows.repartition("trade_date").sortWithinPartitions("trade_date", "stock_code").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trade_date", "batch").parquet(root)


def stored_partials(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root).drop("batch")
