"""Helpers that the corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: XXH64 constants that spread a 64-bit integer (fixed values of the splitmix64 finalizer).
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; without one only a local session (tests) gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once and written to the shared folder.

    Where spark.cleaner.referenceTracking.cleanCheckpoints is set it goes with the last reference, elsewhere with the folder.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: columnar, so later passes read only what they need."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def collected(spark: SparkSession) -> None:
    """Have the driver collect its garbage, on which Spark removes the shuffle files that nothing refers to any more; else they stay on disk till it happens to."""
    gc.collect()
    spark._jvm.System.gc()


#: Bytes of the Arrow batches that Python workers get inside ``small_batches``; Spark's own bound is 64 MB.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside hands Python ``BATCH_BYTES`` at a time (or one row), since lists and nested rows take many times that as Python objects."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def in_small_batches(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator on a DataFrame with all steps that it runs at once under ``small_batches``."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        with small_batches(docs.sparkSession):
            return operator(docs, *args, **kwargs)

    return run


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(docs: DataFrame) -> Column:
    return F.struct(*map(quoted, docs.columns))


def spread_by_key(docs: DataFrame) -> DataFrame:
    """(row, key): whole rows as a struct beside a 64-bit key of them, so that no name of theirs can clash."""
    return docs.select(whole_row(docs).alias("row"), row_key(*docs.columns).alias("key"))


def without_keys(docs: DataFrame, keys: DataFrame, broadcast_rows: int = 2_000_000) -> DataFrame:
    """Rows of ``docs`` whose row key is not in ``keys(key)``; up to ``broadcast_rows`` keys (16 MB) no text is shuffled."""
    keys = cut(keys.distinct())
    few = F.broadcast(keys) if keys.count() <= broadcast_rows else keys
    return spread_by_key(docs).join(few, "key", "left_anti").select("row.*")


def map_rows(df: DataFrame, work: Callable[..., tuple], schema: str) -> DataFrame:
    """Apply ``work(*columns as lists) -> tuple of lists`` to each Arrow batch; ``schema`` names its lists.

    Text columns arrive as given; cast them to binary first where ASCII rules and byte offsets are wanted.
    """
    fields = df.sparkSession.createDataFrame([], schema).schema
    types = [arrow_type(f.dataType.simpleString()) for f in fields]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = work(*(c.to_pylist() for c in b.columns))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=names)

    return df.mapInArrow(run, schema)


def wider(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with more columns."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def arrow_type(name: str) -> pa.DataType:
    plain = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return plain[name] if name in plain else pa.list_(plain[name.removeprefix("array<").removesuffix(">")])


def folded(text: Column | str) -> Column:
    """Text with A-Z lower-cased and nothing else changed; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(mod: int, rest: int) -> Column:
    """True where crc32 of doc_id as text leaves ``rest``; a null id counts as training."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False))


def row_key(*columns: str) -> Column:
    """64-bit key of whole rows; nulls and empty values differ."""
    return F.xxhash64(*(x for c in map(quoted, columns) for x in (c.isNull(), c)))


def ints(xs: list[int]) -> str:
    return ",".join(map(str, xs))


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, most: int = 100_000) -> DataFrame:
    """Inner join of ``rows`` and ``groups`` on ``key``, with no key of many rows in one task; null keys meet.

    ``groups`` has one row for each key of ``rows`` and counts its rows in ``size``. The groups of more
    than a ``most``-th of all rows are fewer than ``most``, whatever the data, and are broadcast; the
    rows of all others are dealt by key, where none is large. Both are read twice: checkpoint them before.
    """
    right = groups.withColumnRenamed(key, "_key")
    total = groups.agg(F.sum(size)).first()[0] or 0
    same = F.col(key).eqNullSafe(F.col("_key"))
    if groups.count() <= most:
        return rows.join(F.broadcast(right), same).drop("_key")
    large = F.broadcast(right.filter(F.col(size) * most > total))
    hot = rows.join(large, same).drop("_key")
    rest = rows.join(large.select("_key"), same, "left_anti").join(right.filter(F.col(size) * most <= total), same).drop("_key")
    return hot.union(rest)
