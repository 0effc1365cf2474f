"""Write policies on Parquet tables: append a version, replace by key, ignore what exists, upsert a column.

The policies are DataFrame to DataFrame; ``publish`` writes a new version of a table beside the
old one, never over the files being read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def one_of_each(df: DataFrame, key: Sequence[str], last: bool, order: str | None = None) -> DataFrame:
    """One row of each key: the last (or first) by ``order`` and then by its other columns, so that reruns agree."""
    way = F.desc_nulls_last if last else F.asc_nulls_last
    rest = [c for c, t in df.dtypes if c not in key and c != order and not t.startswith(("map", "variant"))]
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*([way(order)] if order else []), *map(way, rest), F.lit(0)))
    return df.withColumn("_n", place).filter("_n = 1").drop("_n")


def replaced_by_key(old: DataFrame, new: DataFrame, key: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows of ``new`` take the place of those of ``old`` with their key; of equal keys in ``new`` the last by ``order`` wins (else the greatest row)."""
    new = one_of_each(new, key, True, order)
    new = new.drop(order) if order else new
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def ignored_if_exists(old: DataFrame, new: DataFrame, *keys: Sequence[str]) -> DataFrame:
    """``old`` plus the rows of ``new`` that no key of ``old`` has, nor another row of ``new`` (the least of equal keys stays)."""
    for key in keys:
        new = one_of_each(new, key, False).join(old.select(*key), list(key), "left_anti")
    return old.unionByName(new, allowMissingColumns=True)


def with_column_upserted(wide: DataFrame, new: DataFrame, name: str, key: Sequence[str] = ("trade_date", "stock_code")) -> DataFrame:
    """``wide`` with the non-null values of ``new(key, factor_value)`` in column ``name``, the greatest of a repeated key; other columns are untouched."""
    wide = with_factor_column(wide, name)
    fresh = new.groupBy(*key).agg(F.max("factor_value").alias("_new")).filter(F.col("_new").isNotNull())
    merged = wide.join(fresh, list(key), "full_outer")
    return merged.withColumn(name, F.coalesce("_new", name)).drop("_new").select(*wide.columns)


def with_factor_column(wide: DataFrame, name: str) -> DataFrame:
    """``wide`` with an empty factor column; one that is there stays as it is."""
    return wide if name in wide.columns else wide.withColumn(name, F.lit(None).cast("double"))


def factor_columns(wide: DataFrame) -> list[str]:
    return [c for c in wide.columns if c not in ("trade_date", "stock_code", "loaded_at")]


def pivoted(long: DataFrame, names: Sequence[str], use_latest: bool = True) -> DataFrame:
    """Long factors as one row per date and stock; the newest version of each, or the largest over versions."""
    of = lambda name, c: F.when(F.col("factor_name") == name, F.col(c))
    pick = lambda name: F.max_by(of(name, "factor_value"), of(name, "loaded_at")) if use_latest else F.max(of(name, "factor_value"))
    rows = long.filter(F.col("factor_name").isin(list(names)))
    return rows.groupBy("trade_date", "stock_code").agg(*(pick(n).alias(n) for n in names), F.max("loaded_at").alias("loaded_at"))


def unpivoted(wide: DataFrame, skip_nulls: bool = True) -> DataFrame:
    out = wide.unpivot(["trade_date", "stock_code"], factor_columns(wide), "factor_name", "factor_value")
    return out.filter(F.col("factor_value").isNotNull()) if skip_nulls else out


def migrated(long: DataFrame, names: Sequence[str], now: str) -> tuple[DataFrame, DataFrame]:
    """(wide, history) from a long table: null values go, a missing load time is ``now``."""
    rows = long.filter(F.col("factor_value").isNotNull()).withColumn("loaded_at", F.coalesce("loaded_at", F.lit(now).cast("timestamp")))
    return pivoted(rows, names), rows.select("trade_date", "stock_code", "factor_name", "factor_value", "loaded_at")


def compatibility_view(wide: DataFrame, name: str = "factor_data") -> DataFrame:
    view = unpivoted(wide)
    view.createOrReplaceTempView(name)
    return view


def publish(df: DataFrame, root: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), files: int | None = None, group_rows: int | None = None) -> str:
    """Write a new version directory under ``root`` and return its path; Zstandard, sorted so that row groups can be skipped.

    ``files`` sets the number of ranges of ``sort_by``, ``group_rows`` the most rows of a row group.
    """
    path = f"{root}/v-{uuid.uuid4().hex}"
    if sort_by:
        ranges = df.repartitionByRange(*([files] if files else []), *sort_by)
        df = (df.repartition(*partition_by) if partition_by else ranges).sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.option("compression", "zstd")
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", group_rows)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def stored_bytes(spark: SparkSession, path: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def recompressed(spark: SparkSession, source: str, root: str, sort_by: Sequence[str], group_rows: int = 1_000_000, file_bytes: int = 32 << 20) -> tuple[str, int]:
    """Rewrite a table compressed and sorted by ranges; fails unless the counts agree.

    There is a range for each ``file_bytes`` of the source, and row groups hold ``group_rows`` rows at most, so that a
    reader with a filter on the sort key opens few files and few groups of them. Both counts are read from footers.
    """
    before = spark.read.parquet(source)
    ranges = max(1, -(-stored_bytes(spark, source) // file_bytes))
    path = publish(before, root, sort_by=sort_by, files=ranges, group_rows=group_rows)
    n = spark.read.parquet(path).count()
    if n != before.count():
        raise RuntimeError(f"{path} has {n} rows, {source} has another number")
    return path, n


def new_dates(df: DataFrame, have: DataFrame | None, date: str = "trade_date") -> DataFrame:
    """Rows of the dates that ``have`` lacks."""
    return df if have is None else df.join(have.select(date).distinct(), date, "left_anti")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or for a local session without one a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root or tempfile.mkdtemp(prefix='spark-')}/tables-{uuid.uuid4().hex}"


def append_new_dates(df: DataFrame, path: str, have: DataFrame | None, date: str = "trade_date") -> DataFrame:
    """Write the dates that ``have`` lacks, partitioned by date; returns the rows written, none on a second run."""
    new = new_dates(df, have, date)
    new.repartition(date).sortWithinPartitions("stock_code").write.mode("append").partitionBy(date).parquet(path)
    return new


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows, n_columns) of several tables in one job."""
    parts = [df.agg(F.lit(k).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns")) for k, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def load_summary(df: DataFrame, name: str | None = None) -> DataFrame:
    cols = [F.count(F.lit(1)).alias("n_rows"), F.countDistinct("trade_date").alias("n_days"), F.countDistinct("stock_code").alias("n_stocks"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date")]
    return df.agg(*cols, *([F.countDistinct(name).alias("n_names")] if name else []))


def rows_by_year(df: DataFrame) -> DataFrame:
    return df.groupBy(F.year("trade_date").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def top_names(df: DataFrame, name: str = "factor_name", limit: int = 20) -> DataFrame:
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name).limit(limit)


def not_loaded(offered: DataFrame, have: DataFrame, name: str = "factor_name") -> DataFrame:
    """Names offered that the table does not hold yet."""
    return offered.select(name).distinct().join(have.select(name).distinct(), name, "left_anti")


def field_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    return df.agg(*(F.count(f).alias(f) for f in fields)).unpivot([], list(fields), "field", "n")


def without_names(df: DataFrame, names: Sequence[str], name: str = "factor_name") -> DataFrame:
    return df.filter(~F.col(name).isin(list(names)))
