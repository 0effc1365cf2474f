"""Readers and transforms of landed inputs to the tables of ``schemas``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.exprs import content_id, normalize_code
from quantloom.schemas import KEYS, schema

DAILY_FIELDS = ("open", "high", "low", "close", "volume", "amount", "adj_factor", "turnover")
#: Header aliases of landed files, and the indicators of the World Bank.
MACRO_ALIASES = {"date": "trade_date", "日期": "trade_date", "indicator": "indicator_id", "指标": "indicator_id", "指标名称": "indicator_name", "数值": "value", "val": "value"}
NEWS_ALIASES = {"id": "news_id", "date": "publish_date", "time": "publish_time", "source": "source_id", "stocks": "related_stocks", "industries": "related_industries", "score": "sentiment_score", "label": "sentiment_label"}
REPORT_ALIASES = {"id": "report_id", "date": "publish_date", "stock": "related_stock"}
ALTERNATIVE_ALIASES = {
    "date": "trade_date", "日期": "trade_date", "type": "data_type", "类型": "data_type", "subtype": "data_subtype", "子类型": "data_subtype",
    "entity": "entity_id", "实体": "entity_id", "实体名称": "entity_name", "val": "value", "数值": "value",
}
VENDOR_ALIASES = {
    "Stkcd": "stock_code", "Trddt": "trade_date", "Trdwnt": "trade_date", "Trmnt": "trade_date", "Trdynt": "trade_date",
    "Markettype": "market_type", "MarketType": "market_type", "MarkettypeID": "market_type", "Status": "status",
}
VENDOR_NOT_FACTORS = ("stock_code", "trade_date", "market_type", "status", "证券代码", "交易日期", "市场类型", "交易状态")
WORLD_INDICATORS = {
    "NY.GDP.MKTP.CD": "GDP", "NY.GDP.MKTP.KD.ZG": "GDP_GROWTH", "FP.CPI.TOTL.ZG": "CPI", "FR.INR.RINR": "REAL_INTEREST_RATE", "SL.UEM.TOTL.ZS": "UNEMPLOYMENT",
    "FM.LBL.BMNY.CN": "M2", "NE.TRD.GNFS.ZS": "TRADE_PERCENT_GDP", "GC.DOD.TOTL.GD.ZS": "GOVT_DEBT_PERCENT_GDP", "SP.POP.TOTL": "POPULATION", "PA.NUS.FRTF": "EXCHANGE_RATE",
}
#: Words of date and value columns, and the categories and sources that every catalogue starts with.
DATE_WORDS, VALUE_WORDS = ("日期", "date", "时间", "time", "年份"), ("值", "value", "数值", "同比", "增速")
CATEGORIES = [("price", 1), ("factor", 2), ("macro", 3), ("sentiment", 4), ("alternative", 5)]
SOURCES = [("tushare", "daily"), ("akshare", "daily"), ("eastmoney", "realtime"), ("sina", "realtime")]


#: Columns of the log of ingest runs.
OUTCOME = "source string, table_name string, n long, error string"


def read(spark: SparkSession, path: str, kind: str | None = None, ddl: str | None = None) -> DataFrame:
    """A csv, json or Parquet file or directory; other formats are converted beforehand."""
    kind = kind or path.rsplit(".", 1)[-1].lower()
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"unsupported format: {kind}")
    reader = spark.read.schema(ddl) if ddl else spark.read
    return reader.csv(path, header=True) if kind == "csv" else getattr(reader, kind)(path)


def read_fields(spark: SparkSession, directory: str, kind: str = "parquet", ddl: str | None = None) -> DataFrame:
    """Every file of a directory tree in one read; ``field`` is the file's stem, ``category`` its folder.

    A table that Spark wrote as a folder, ``pe.parquet/part-...``, counts as a file. The names are read from the list of
    files, a row each, and not from every row; a path that is not in the list as Spark spells it is parsed by row.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    reader = reader.schema(ddl) if ddl else reader
    rows = reader.option("header", "true").format(kind).load(directory)
    place = r"([^/]+)/([^/]+?)\.[A-Za-z]+(?:/part-[^/]*)?$"
    names = {"field": F.regexp_extract("_file", place, 2), "category": F.regexp_extract("_file", place, 1)}
    files = spark.createDataFrame([(x,) for x in sorted(set(rows.inputFiles()))], "_file string").withColumns({f"_{k}": v for k, v in names.items()})
    named = rows.withColumn("_file", F.input_file_name()).join(F.broadcast(files), "_file", "left")  # a row a file
    return named.withColumns({k: F.coalesce(f"_{k}", v) for k, v in names.items()}).drop("_file", *(f"_{k}" for k in names))


def renamed(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in aliases.items() if k in df.columns and v not in df.columns})


def required(df: DataFrame, *names: str) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def unpivot_matrix(wide: DataFrame, date: str = "trade_date", value: str = "val") -> DataFrame:
    """Dates by codes as (trade_date, stock_code, value): non-null doubles, six-digit codes; codes that collide fail."""
    codes = [c for c in wide.columns if c != date]
    bare = [c.strip().split(".")[0].rjust(6, "0") for c in codes]
    if len(set(bare)) < len(bare):
        raise ValueError("two columns are the same stock code")
    typed = wide.select(F.to_date(date).alias("trade_date"), *(F.expr(f"try_cast(`{c}` as double)").alias(c) for c in codes))
    long = typed.unpivot(["trade_date"], codes, "stock_code", value).filter(F.col(value).isNotNull())
    return long.withColumn("stock_code", normalize_code("stock_code"))


def in_blocks(cells: Column, width: int = 256) -> Column:
    """An array as arrays of ``width`` cells at most, in order."""
    starts = F.sequence(F.lit(0), F.floor((F.size(cells) - 1) / width).cast("int"))
    return F.transform(starts, lambda b: F.slice(cells, b * width + 1, width))


def read_matrix(spark: SparkSession, path: str, date: str = "trade_date", value: str = "val") -> DataFrame:
    """Landed text matrices, dates by codes, as (trade_date, stock_code, value) like ``unpivot_matrix``, whatever their width.

    Lines are split into cells by position, and a cell's code is that of the header of its own file, so that columns
    are data: the plan does not grow with them. A header begins with ``date``, wherever a split of the file begins.
    Cells meet their codes in blocks, so what is joined is a row a line and block.
    """
    lines = spark.read.text(path).select("value", F.trim(F.substring_index("value", ",", 1)).alias("first"), F.col("_metadata.file_path").alias("file"))
    split = F.split("value", ",")
    cells = F.slice(split, F.lit(2), F.size(split))
    blocks = lambda rows, *names: rows.select(*names, cells.alias("cells")).filter(F.size("cells") > 0).select(*names, F.posexplode(in_blocks(F.col("cells"))).alias("block", "cells"))
    heads = blocks(lines.filter(F.col("first") == date), "file")
    heads = heads.select("file", "block", F.transform("cells", normalize_code).alias("codes"))
    twice = heads.select("file", F.explode("codes").alias("stock_code")).groupBy("file", "stock_code").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two columns of {twice[0]['file']} are the same stock code")
    rows = blocks(lines.withColumn("trade_date", F.expr("try_cast(first as date)")).filter("trade_date is not null"), "file", "trade_date")
    both = rows.join(heads, ["file", "block"]).select("trade_date", F.inline(F.arrays_zip("codes", "cells")).alias("stock_code", "cell"))
    # most cells of a wide matrix may be empty: they go before the cast, which is slow for what is no number
    typed = both.filter("stock_code is not null and cell != ''").withColumn(value, F.expr("try_cast(cell as double)"))
    return typed.filter(F.col(value).isNotNull()).select("trade_date", "stock_code", value)


def as_version(long: DataFrame, field: str, loaded_at: str, value: str = "val") -> tuple[str, DataFrame]:
    """(table, rows): a price field becomes a version with that field alone, any other a factor."""
    at = F.lit(loaded_at).cast("timestamp").alias("loaded_at")
    if field in DAILY_FIELDS:
        empty = [(F.col(value) if f == field else F.lit(None)).cast("bigint" if f == "volume" else "double").alias(f) for f in DAILY_FIELDS]
        return "daily_prices", long.select("trade_date", "stock_code", at, *empty)
    return "factor_data", long.select("trade_date", "stock_code", F.lit(field).alias("factor_name"), at, F.col(value).cast("double").alias("factor_value"))


def level1_rows(raw: DataFrame, date: Column | None = None) -> DataFrame:
    """HHMMSS integers to seconds of the day, codes to six digits, the date from the file name unless given.

    The date is the eight digits of the file's name, or of the folder's, for a table that Spark wrote as ``20240103.csv/part-...``.
    """
    t = F.col("time")
    sec = F.floor(t / 10000) * 3600 + F.floor(t / 100) % 100 * 60 + t % 100
    day = date if date is not None else F.to_date(F.regexp_extract(F.col("_metadata.file_path"), r"(\d{8})[^/]*(?:/part-[^/]*)?$", 1), "yyyyMMdd")
    return raw.select(day.alias("trade_date"), sec.cast("int").alias("trade_sec"), normalize_code("stock_code").alias("stock_code"), "open", "high", "low", "close", F.col("volume").cast("long").alias("volume"), F.col("amount").cast("double").alias("amount"))


def with_adj_factor(prices: DataFrame, new: DataFrame, append_at: str | None = None) -> DataFrame:
    """New factors in every version of a key, or, with ``append_at``, as a new version of the newest one."""
    fresh = new.select("trade_date", "stock_code", F.col("adj_factor").alias("_adj"))
    if append_at is None:
        joined = prices.join(fresh, ["trade_date", "stock_code"], "left")
        return joined.withColumn("adj_factor", F.coalesce("_adj", "adj_factor")).drop("_adj").select(*prices.columns)
    newest = F.row_number().over(Window.partitionBy("trade_date", "stock_code").orderBy(F.desc("loaded_at")))
    last = prices.withColumn("_n", newest).filter("_n = 1").drop("_n").join(fresh, ["trade_date", "stock_code"])
    changed = last.withColumn("adj_factor", F.col("_adj")).withColumn("loaded_at", F.lit(append_at).cast("timestamp")).select(*prices.columns)
    return prices.union(changed)


def stock_table(listed: DataFrame, names: DataFrame, industries: DataFrame) -> DataFrame:
    """stock_code with list_date, stock_name and the industry of the last date of ``industries(trade_date, stock_code, industry)``."""
    last = industries.filter(F.col("industry").isNotNull()).groupBy("stock_code").agg(F.max_by("industry", "trade_date").alias("industry"))
    return listed.join(names, "stock_code", "full_outer").join(last, "stock_code", "full_outer")


def trade_calendar(prices: DataFrame) -> DataFrame:
    """Every day between first and last; the end flags mark the last trading day of a month, quarter or year."""
    traded = prices.select("trade_date").distinct().withColumn("is_trading_day", F.lit(True))
    span = prices.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("trade_date")).join(traded, "trade_date", "left").fillna(False, ["is_trading_day"])
    after = F.lead("trade_date").over(Window.partitionBy("is_trading_day").orderBy("trade_date"))
    ends = {f"is_{p}_end": F.col("is_trading_day") & F.coalesce(F.trunc("trade_date", p) != F.trunc(after, p), F.lit(True)) for p in ("month", "quarter", "year")}
    return days.withColumn("week_day", F.weekday("trade_date")).withColumns(ends)


def suspend_flags(long: DataFrame, value: str = "val") -> DataFrame:
    flag = F.when(F.col(value) == "S", 1.0).when(F.col(value) == "R", 0.0)
    return long.withColumn(value, flag).filter(F.col(value).isNotNull())


def exploded_factors(nested: DataFrame, column: str = "factors", prefix: str = "barra_tl_", skip: Sequence[str] = ("_id", "INDNAME")) -> DataFrame:
    """(trade_date, map of factor to map of code to value) as long factor rows."""
    outer = nested.select("trade_date", F.explode(column).alias("name", "codes")).filter(~F.col("name").isin(list(skip)))
    inner = outer.select("trade_date", F.concat(F.lit(prefix), "name").alias("factor_name"), F.explode("codes").alias("stock_code", "factor_value"))
    return inner.filter(F.col("factor_value").isNotNull()).withColumn("stock_code", normalize_code("stock_code"))


def vendor_rows(raw: DataFrame, metadata_rows: Column | None = None) -> DataFrame:
    """Vendor headers to ours, codes and dates cleaned, other columns numeric where they can be; bad keys go.

    ``metadata_rows`` tells which rows describe columns instead of holding data.
    """
    if metadata_rows is not None:
        raw = raw.filter(~metadata_rows)
    df = renamed(raw, VENDOR_ALIASES)
    numeric = [c for c in df.columns if c not in VENDOR_NOT_FACTORS]
    out = df.withColumns({"trade_date": F.try_to_timestamp("trade_date").cast("date"), **{c: F.expr(f"try_cast(`{c}` as double)") for c in numeric}})
    out = out.filter(F.col("trade_date").isNotNull())
    return out.withColumn("stock_code", normalize_code("stock_code")).filter("stock_code != ''") if "stock_code" in out.columns else out


def vendor_factors(rows: DataFrame, name: str, loaded_at: str, market: bool = False) -> DataFrame:
    """Long factor rows: named ``name``, or name_column with several value columns; ``market`` rows have no stock."""
    values = [c for c in rows.columns if c not in VENDOR_NOT_FACTORS]
    rows = rows.withColumn("stock_code", F.lit("MARKET")) if market else rows
    long = rows.unpivot(["trade_date", "stock_code"], values, "_column", "factor_value").filter(F.col("factor_value").isNotNull())
    label = F.concat_ws("_", F.lit(name), "_column") if len(values) > 1 else F.lit(name)
    return long.select("trade_date", "stock_code", label.alias("factor_name"), F.lit(loaded_at).cast("timestamp").alias("loaded_at"), "factor_value")


def conformed(df: DataFrame, table: str) -> DataFrame:
    """Exactly the table's columns and types; absent ones are null."""
    fields = schema(table).fields
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def macro_rows(raw: DataFrame, indicator: str | None = None) -> DataFrame:
    df = renamed(raw, MACRO_ALIASES)
    if indicator is not None and "indicator_id" not in df.columns:
        df = df.withColumn("indicator_id", F.lit(indicator))
    df = required(df, "trade_date", "value", "indicator_id").withColumn("trade_date", F.to_date("trade_date"))
    defaults = {"value_type": F.lit("raw"), "data_quality": F.lit(100)}
    return conformed(df.withColumns({k: v for k, v in defaults.items() if k not in df.columns}), "macro_data")


def as_list(c: str) -> Column:
    return F.coalesce(F.transform(F.split(F.col(c), ","), lambda x: F.trim(x)), F.array().cast("array<string>"))


def news_rows(raw: DataFrame) -> DataFrame:
    df = required(renamed(raw, NEWS_ALIASES), "news_id", "publish_date", "title").withColumn("publish_date", F.to_date("publish_date"))
    kinds = dict(df.dtypes)
    return conformed(df.withColumns({c: as_list(c) for c in ("related_stocks", "related_industries") if kinds.get(c) == "string"}), "news_sentiment")


def report_rows(raw: DataFrame) -> DataFrame:
    df = required(renamed(raw, REPORT_ALIASES), "report_id", "publish_date", "title")
    return conformed(df.withColumn("publish_date", F.to_date("publish_date")), "report_sentiment")


def alternative_rows(raw: DataFrame, data_type: str | None = None) -> DataFrame:
    df = required(renamed(raw, ALTERNATIVE_ALIASES), "trade_date", "value", "entity_id").withColumn("trade_date", F.to_date("trade_date"))
    if data_type is not None and "data_type" not in df.columns:
        df = df.withColumn("data_type", F.lit(data_type))
    defaults = {"data_subtype": F.lit(""), "entity_type": F.lit("unknown"), "data_quality": F.lit(100)}
    df = df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})
    if "data_id" not in df.columns:
        df = df.withColumn("data_id", F.concat_ws("_", "data_type", F.coalesce("data_subtype", F.lit("")), "entity_id", F.col("trade_date").cast("string")))
    kind = dict(df.dtypes).get("metadata", "string")
    return conformed(df if kind == "string" else df.withColumn("metadata", F.to_json("metadata")), "alternative_data")


def default_metadata(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Categories and sources that every catalogue starts with."""
    cats = spark.createDataFrame(CATEGORIES, "category_id string, priority int")
    srcs = spark.createDataFrame(SOURCES, "source_id string, update_frequency string").withColumn("is_active", F.lit(True))
    return conformed(cats.withColumn("category_name", F.col("category_id")), "data_categories"), conformed(srcs.withColumn("source_name", F.col("source_id")), "data_sources")


def active_sources(sources: DataFrame) -> DataFrame:
    return sources.filter("is_active").orderBy("source_id")


def fields_of(dictionary: DataFrame, category: str | None = None) -> DataFrame:
    return (dictionary if category is None else dictionary.filter(F.col("category_id") == category)).orderBy("field_id")


def route(df: DataFrame) -> str:
    """Table that the columns belong to."""
    names = set(df.columns)
    macro = names | {MACRO_ALIASES[c] for c in names if c in MACRO_ALIASES}
    if "report_id" in names:
        return "report_sentiment"
    if "news_id" in names or {"publish_date", "title"} <= names:
        return "news_sentiment"
    if {"indicator_id", "value"} <= macro:
        return "macro_data"
    if names & {"data_type", "data_id"}:
        return "alternative_data"
    raise ValueError(f"no table has the columns {sorted(names)}")


LOADERS: dict[str, Callable[[DataFrame], DataFrame]] = {"macro_data": macro_rows, "news_sentiment": news_rows, "report_sentiment": report_rows, "alternative_data": alternative_rows}


def ingest(sources: Mapping[str, DataFrame], store: Callable[[str, DataFrame], DataFrame | None], run_at: str) -> DataFrame:
    """Route and store each source; a row of outcome for each: rows stored, 0, or -1 and the error.

    ``store`` returns what it has stored, so that a source is not computed again to count it.
    """
    spark, log = None, []
    for name, df in sources.items():
        spark = df.sparkSession
        try:
            table = route(df)
            rows = LOADERS[table](df)
            kept = store(table, rows)
            log.append((name, table, (rows if kept is None else kept).count(), None))
        except Exception as e:  # one bad source must not stop the others; the outcome keeps the reason
            log.append((name, None, -1, str(e)[:200]))
    if spark is None:
        raise ValueError("no sources")
    return spark.createDataFrame(log, "source string, table_name string, n long, error string").withColumn("run_at", F.lit(run_at).cast("timestamp"))


def stored_run(sources: Mapping[str, DataFrame], root: str, run: str, run_at: str, tables: Sequence[str] = (), at_once: int = 4) -> DataFrame:
    """Route and store each source under ``root``, several at once, and add their outcomes to the stored log, which is returned as of this run.

    With ``tables`` only the sources of these tables are run. Rows are counted while they are written. A source that
    fails is logged with -1 and its error, and does not stop the others. Each source and run has a folder of
    its own, so that a run can be repeated and writers do not meet.
    """
    if not sources:
        raise ValueError("no sources")
    spark = next(iter(sources.values())).sparkSession

    def one(item: tuple[str, DataFrame]) -> tuple | None:
        name, df = item
        try:
            table = route(df)
        except Exception as e:  # logged: one bad source must not stop the others
            return None if tables else (name, None, -1, str(e)[:200])
        if tables and table not in tables:
            return None
        try:
            counted = Observation()
            rows = LOADERS[table](df).observe(counted, F.count(F.lit(1)).alias("n"))
            rows.write.mode("overwrite").parquet(f"{root}/{table}/source={name}/run={run}")
            return name, table, counted.get["n"], None
        except Exception as e:
            return name, table, -1, str(e)[:200]

    with ThreadPoolExecutor(at_once) as pool:
        log = [x for x in pool.map(one, sources.items()) if x is not None]
    done = spark.createDataFrame(log, OUTCOME).withColumn("run_at", F.lit(run_at).cast("timestamp"))
    done.coalesce(1).write.mode("overwrite").parquet(f"{root}/ingest_log/run={run}")
    return done


def ingest_log(spark: SparkSession, root: str, source: str | None = None, failed: bool = False) -> DataFrame:
    """Outcomes of all runs, newest first; of one source, or failures alone."""
    log = spark.read.schema(f"{OUTCOME}, run_at timestamp, run string").parquet(f"{root}/ingest_log")
    if source is not None:
        log = log.filter(F.col("source") == source)
    return (log.filter("n < 0") if failed else log).orderBy(F.desc("run_at"), "source")


def ingest_status(spark: SparkSession, root: str) -> DataFrame:
    """Per source the last outcome, the last success, and how often it ran, failed and what it stored."""
    log = ingest_log(spark, root)
    return log.groupBy("source").agg(
        F.max_by("n", F.struct("run_at", "run")).alias("last_n"), F.max("run_at").alias("last_run"), F.max(F.when(F.col("n") >= 0, F.col("run_at"))).alias("last_success"),
        F.count(F.lit(1)).alias("n_runs"), F.count(F.when(F.col("n") < 0, 1)).alias("n_failed"), F.sum(F.greatest("n", F.lit(0))).alias("n_stored"),
    )


def stored_rows(spark: SparkSession, root: str, table: str) -> DataFrame:
    """What all runs have stored of a table; of rows with one key those of the newest run count."""
    rows = spark.read.schema(f"{schema(table).toDDL()}, source string, run string").parquet(f"{root}/{table}")
    newest = F.rank().over(Window.partitionBy(*KEYS[table]).orderBy(F.desc("run")))
    return rows.withColumn("_newest", newest).filter("_newest = 1").drop("_newest", "source", "run")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, at) of text files; ``at`` numbers the lines of each file's first split from 0, and is null in later ones.

    Lines of a split are read in order by one task, so their running ids are consecutive, whatever the splits.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    starts = lines.filter("block = 0").groupBy(F.col("file").alias("_file")).agg(F.min("id").alias("start"))
    joined = lines.join(starts, F.col("file") == F.col("_file"))
    return joined.select("file", "line", F.when(F.col("block") == 0, F.col("id") - F.col("start")).alias("at"))


def read_vendor(spark: SparkSession, path: str, metadata_rows: int = 2) -> DataFrame:
    """Vendor CSV files as text columns: the first line of each file names them, the next ``metadata_rows`` describe them and are skipped.

    Files may differ in their columns; those of one kind are parsed together, and there are as many kinds as different headers.
    """
    lines = numbered_lines(spark, path)
    heads = lines.filter("at = 0").select(F.col("file").alias("_file"), F.regexp_replace("line", "^\ufeff", "").alias("head"))
    kinds = [r["head"] for r in heads.select("head").distinct().orderBy("head").collect()]  # a row a kind of file
    body = lines.filter((F.col("at").isNull() | (F.col("at") > metadata_rows)) & (F.trim("line") != "")).join(heads, F.col("file") == F.col("_file"))
    parts = []
    for head in kinds:
        names = [x.strip().strip('"') for x in head.split(",")]
        ddl = ", ".join(f"`{x.replace('`', '``')}` string" for x in names)
        parts.append(body.filter(F.col("head") == head).select(F.from_csv("line", ddl).alias("r")).select("r.*"))
    if not parts:
        raise ValueError(f"{path} has no lines")
    return combined(parts)


def world_rows(raw: DataFrame, column: str = "json") -> DataFrame:
    """Landed World-Bank responses, [header, records], as macro rows."""
    record = "array<struct<indicator:struct<id:string,value:string>,date:string,value:double>>"
    records = F.from_json(F.get_json_object(column, "$[1]"), record)
    rows = raw.select(F.explode(records).alias("r")).filter("r.value is not null")
    known = F.create_map(*(F.lit(x) for kv in WORLD_INDICATORS.items() for x in kv))
    names = rows.select(F.to_date(F.rpad("r.date", 4, " "), "yyyy").alias("trade_date"), F.coalesce(F.try_element_at(known, F.col("r.indicator.id")), F.col("r.indicator.id")).alias("indicator_id"), F.col("r.indicator.value").alias("indicator_name"), F.col("r.value").alias("value"), F.lit("worldbank").alias("source_id"))
    return macro_rows(names)


def feed_rows(items: DataFrame, source: str) -> DataFrame:
    """Landed feed items (title, link, published) as news rows."""
    rows = items.select(content_id("rss_", "title", "link").alias("news_id"), F.to_date("published").alias("publish_date"), "title", F.lit(source).alias("source_id"), F.lit(0.0).alias("sentiment_score"), F.lit("neutral").alias("sentiment_label"))
    return news_rows(rows)


def policy_rows(pages: DataFrame, run_date: dt.date, most: int = 20, least_chars: int = 5, classed: bool = True) -> DataFrame:
    """First links and list items of each page, with their text and address, as alternative rows; text under ``least_chars`` goes after the cut."""
    tag = r'(?is)<(a|li)\b([^>]*?class\s*=[^>]*)>(.*?)</\1>' if classed else r"(?is)<(a)\b([^>]*)>(.*?)</\1>"
    found = pages.select("page_id", F.posexplode(F.slice(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), 1, most)).alias("place", "element"))
    text = F.trim(F.regexp_replace("element", r"<[^>]*>", ""))
    link = F.regexp_extract("element", r'href="([^"]*)"', 1)
    rows = found.select("page_id", "place", text.alias("value_text"), link.alias("url")).filter(F.length("value_text") >= least_chars)
    return rows.withColumns({"data_id": content_id("gov_", "value_text", "url"), "trade_date": F.lit(run_date)})


def detected(raw: DataFrame, indicator: str, source: str = "akshare") -> DataFrame:
    """Date and value columns by name (the last that fits, else the first two) as macro rows."""
    fits = lambda words: [c for c in raw.columns if any(w in c.lower() for w in words)]
    date = (fits(DATE_WORDS) or raw.columns[:1])[-1]
    value = (fits(VALUE_WORDS) or raw.columns[1:2] or raw.columns[:1])[-1]
    rows = raw.select(F.to_date(date).alias("trade_date"), F.lit(indicator).alias("indicator_id"), F.lit(indicator).alias("indicator_name"), F.expr(f"try_cast(`{value}` as double)").alias("value"), F.lit(source).alias("source_id"))
    return macro_rows(rows.filter(F.col("value").isNotNull()))


def combined(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def key_of(table: str) -> tuple[str, ...]:
    return KEYS[table]
