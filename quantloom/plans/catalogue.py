"""Registered queries: every operator over fixtures of the given tables, with the same result in plain SQL.

Doubles are rounded on both sides, as the order of sums differs between engines.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions import exprs
from quantloom.functions.predicates import QueryFilter, between, members
from quantloom.operators import calc, checks, factors, fusion, macro, matrix, news, pit, prices
from quantloom.plans.fixtures import frame, with_fixtures
from quantloom.sources import ingest, sinks, stored
from quantloom.streaming import feeds

MAKE: dict[str, Callable] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DAY, FUSION = dt.date(1998, 1, 15), dt.date(1998, 1, 1)
START, END, AS_OF = dt.date(1998, 1, 1), dt.date(1998, 6, 30), "1998-03-01"
CODES = ("000001", "000002", "000007")
IN_RANGE = "trade_date between date '1998-01-01' and date '1998-06-30'"
IN_CODES = "stock_code in ('000001', '000002', '000007')"
BAR = "open, high, low, close, volume, amount, adj_factor"
IDS = ["PMI", "CPI_yoy", "M2_yoy"]


class Tables:
    """Fixtures and given tables of one data directory, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = self.table(name)
        if name == "news_sentiment":
            return df.withColumn("related_stocks", F.array("stock_a", "stock_b")).drop("stock_a", "stock_b")
        return df

    def table(self, name: str) -> DataFrame:
        return frame(self.spark, self.sf_dir, name)

    def latest_bars(self) -> DataFrame:
        return pit.latest(self.bars_versions, non_null=("close",))

    def pe(self, date: dt.date) -> DataFrame:
        return factors.factor("PE", self.factor_long, start=date, end=date)


class Stored(Tables):
    """The same tables as loaded: written once as Parquet, sorted by stock and date."""

    def __init__(self, spark: SparkSession, sf_dir: str, root: str, names: list[str]):
        super().__init__(spark, sf_dir)
        self.paths = {n: sinks.publish(frame(spark, sf_dir, n), f"{root}/{n}", sort_by=[c for c in ("stock_code", "trade_date") if c in frame(spark, sf_dir, n).columns]) for n in names}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.paths[name]) if name in self.paths else super().table(name)


def rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def register(name: str, sql: str | None, doubles: str = "", digits: int = 6):
    """Decorator: a query over Tables, and its SQL with the named double columns rounded alike."""

    def add(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        MAKE[name] = make
        QUERIES[name] = lambda spark, sf_dir: rounded(make(Tables(spark, sf_dir)), digits)
        if sql is not None:
            parts = ", ".join(f"round(cast({c} as double), {digits}) + 0.0 as {c}" for c in doubles.replace(",", " ").split())
            ORACLES[name] = with_fixtures(f"select {f'* replace ({parts})' if parts else '*'} from ({sql}) result")
        return make

    return add


def newest(table: str, key: str = "trade_date, stock_code", where: str = "true") -> str:
    return f"(select * exclude (rk) from (select *, rank() over (partition by {key} order by loaded_at desc) as rk from {{{table}}} where {where}) ranked where rk = 1)"


BARS_NOW = newest("bars_versions", where="close is not null")
LONG = "trade_date, stock_code, factor_name"
PE_DAY = newest("factor_long", LONG, f"factor_name = 'PE' and trade_date = date '{DAY}'")
PE_FUSION = newest("factor_long", LONG, f"factor_name = 'PE' and trade_date = date '{FUSION}'")


def corr(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def stats(value: str) -> str:
    return f"count(*) as n, avg({value}) as mean, stddev_samp({value}) as std, min({value}) as least, max({value}) as most, median({value}) as median"


# --- B: predicates and point-in-time -----------------------------------------------------------------------------

register("b1_date_range", f"select trade_date, stock_code, close from {{bars}} where {IN_RANGE}", "close")(lambda t: between(t.bars, START, END).select("trade_date", "stock_code", "close"))
register("b2_membership", f"select trade_date, stock_code, close from {{bars}} where {IN_CODES}", "close")(lambda t: members(t.bars, CODES).select("trade_date", "stock_code", "close"))
register("b3_projection", "select stock_code, volume from {bars}")(lambda t: QueryFilter(fields=("stock_code", "volume")).apply(t.bars, prices.DAILY))
_versions = f"trade_date, stock_code, {BAR}, cast(loaded_at as date) as loaded"
_loaded = lambda df: df.select("trade_date", "stock_code", *BAR.split(", "), F.to_date("loaded_at").alias("loaded"))
register("b4_pit_latest", f"select {_versions} from {newest('bars_versions')} x", BAR.replace("volume, ", ""), 7)(lambda t: _loaded(pit.latest(t.bars_versions)))
register("b5_pit_non_null", f"select {_versions} from {BARS_NOW} x", BAR.replace("volume, ", ""), 7)(lambda t: _loaded(t.latest_bars()))
register("b6_pit_as_of", f"select {_versions} from {newest('bars_versions', where=f'''loaded_at <= timestamp '{AS_OF} 00:00:00' and close is not null''')} x", BAR.replace("volume, ", ""), 7)(
    lambda t: _loaded(pit.latest(t.bars_versions, as_of=AS_OF, non_null=("close",)))
)
register(
    "b7_pit_by_field",
    "select trade_date, stock_code, arg_max(open, loaded_at) filter (where open is not null) as open, arg_max(high, loaded_at) filter (where high is not null) as high, arg_max(close, loaded_at) filter (where close is not null) as close from {field_versions} group by all",
    "open high close", 7,
)(lambda t: pit.latest_fields(t.field_versions, ["open", "high", "close"]))
register(
    "b8_compaction",
    f"select {_versions} from (select *, max(case when loaded_at < timestamp '{AS_OF} 00:00:00' then loaded_at end) over (partition by trade_date, stock_code) as old from {{bars_versions}}) x where loaded_at >= timestamp '{AS_OF} 00:00:00' or loaded_at = old",
    BAR.replace("volume, ", ""), 7,
)(lambda t: _loaded(pit.compacted(t.bars_versions, AS_OF)))

# --- U: column functions -----------------------------------------------------------------------------------------

register("u1_normalize_code", f"select s_suppkey, lpad(cast(s_suppkey as varchar), 6, '0') as code from {{supplier}}")(lambda t: t.supplier.select("s_suppkey", exprs.normalize_code(F.concat(F.col("s_suppkey").cast("string"), F.lit(".SZ "))).alias("code")))
register("u2_is_index_code", "select s_suppkey, s_suppkey % 2 = 0 as is_index from {supplier}")(
    lambda t: t.supplier.select("s_suppkey", exprs.is_index_code(F.when(F.col("s_suppkey") % 2 == 0, F.lit("000001.sh")).otherwise("000001")).alias("is_index"))
)
register(
    "u3_market", "select s_suppkey, case s_suppkey % 10 when 6 then 'SH' when 8 then 'BJ' when 9 then 'BJ' else 'SZ' end as market from {supplier}"
)(lambda t: t.supplier.select("s_suppkey", exprs.market_of(F.rpad((F.col("s_suppkey") % 10).cast("string"), 6, "0")).alias("market")))
register(
    "u4_adjustment", "select trade_date, stock_code, close * adj_factor as forward, case when adj_factor = 0 then close else close / adj_factor end as backward from {bars}", "forward backward", 7
)(lambda t: t.bars.select("trade_date", "stock_code", exprs.adjusted("close", "adj_factor", "forward").alias("forward"), exprs.adjusted("close", "adj_factor", "backward").alias("backward")))
register("u5_buckets", "select news_id, publish_date as d, cast(date_trunc('week', publish_date) as date) as w, cast(date_trunc('month', publish_date) as date) as m from {news_sentiment}")(
    lambda t: t.news_sentiment.select("news_id", *(exprs.bucket("publish_date", k).alias(k.lower()) for k in "DWM"))
)
register("u6_hotness", "select news_id, coalesce(read_count, 0) + 2 * coalesce(comment_count, 0) as hot from {news_sentiment}")(lambda t: t.news_sentiment.select("news_id", exprs.hotness("read_count", "comment_count").alias("hot")))
register("u7_content_id", "select news_id, concat('rss_', substring(md5(concat(title, news_id)), 1, 16)) as content_id from {news_sentiment}")(
    lambda t: t.news_sentiment.select("news_id", exprs.content_id("rss_", "title", "news_id").alias("content_id"))
)
register("u8_days_behind", "select stock_code, date_diff('day', max(trade_date), date '2002-01-01') as behind from {bars} group by stock_code")(
    lambda t: t.bars.groupBy("stock_code").agg(F.max("trade_date").alias("d")).select("stock_code", exprs.days_behind("d", dt.date(2002, 1, 1)).cast("long").alias("behind"))
)

# --- P: prices ---------------------------------------------------------------------------------------------------

_p1 = f"select trade_date, stock_code, {BAR} from {newest('bars_versions', where=f'close is not null and {IN_CODES} and {IN_RANGE}')} x"
register("p1_daily", _p1, BAR.replace("volume, ", ""), 7)(lambda t: prices.daily(t.bars_versions, QueryFilter(START, END, CODES)))
_tick = "event_id, trade_date, cast(trade_sec as bigint) as trade_sec, stock_code, close, volume, amount"
register("p2_level1", f"select {_tick} from {{ticks}} where trade_date = date '2024-01-03' and trade_sec between 36000 and 37800", "close amount")(
    lambda t: prices.level1(t.ticks, (), dt.date(2024, 1, 3), 36000, 37800, ("event_id", "trade_date", F.col("trade_sec").cast("long").alias("trade_sec"), "stock_code", "close", "volume", "amount"))
)
register("p3_level1_codes", f"select {_tick} from {{ticks}} where {IN_CODES}", "close amount")(
    lambda t: prices.level1(t.ticks, CODES, fields=("event_id", "trade_date", F.col("trade_sec").cast("long").alias("trade_sec"), "stock_code", "close", "volume", "amount"))
)
_matrix = ", ".join(f"max(case when stock_code = '{c}' then close * adj_factor end) as \"{c}\"" for c in CODES)
register("p4_price_matrix", f"select trade_date, {_matrix} from {BARS_NOW} x where {IN_CODES} and {IN_RANGE} group by trade_date", " ".join(f'"{c}"' for c in CODES), 7)(
    lambda t: prices.price_matrix(t.bars_versions, "close", CODES, START, END, "forward")
)
_calendar = """select d as trade_date, d in (select trade_date from {bars}) as is_trading_day from (select cast(unnest(generate_series(min(trade_date), max(trade_date), interval 1 day)) as date) as d from {bars}) g"""
register("p5_trade_dates", f"select trade_date from ({_calendar}) c where is_trading_day and {IN_RANGE}")(lambda t: prices.trade_dates(ingest.trade_calendar(t.bars), START, END))
register("p6_stock_list", "select stock_code, stock_name, industry from {stock_info} where industry = 'NATION_5'")(lambda t: prices.stock_list(t.stock_info, "NATION_5"))
register("p7_date_range", "select min(trade_date) as first_date, max(trade_date) as last_date from {bars_versions}")(lambda t: prices.date_range(t.bars_versions))


@register(
    "p8_panel",
    " union all ".join(f"select trade_date, {i} as place, max(case when stock_code = '{c}' then close end) as close, max(case when stock_code = '{c}' then volume end) as volume from {BARS_NOW} x{i} where {IN_CODES} group by trade_date" for i, c in enumerate(CODES)),
    "close", 7,
)
def p8(t: Tables) -> DataFrame:
    wide = prices.panel(t.latest_bars(), ["close", "volume"], CODES)
    return wide.select("trade_date", F.posexplode(F.arrays_zip("close", "volume")).alias("place", "v")).select("trade_date", "place", F.col("v.close").alias("close"), F.col("v.volume").alias("volume"))


@register(
    "p9_level1_panel",
    " union all ".join(f"select trade_sec, {i} as place, max(case when stock_code = '{c}' then close end) as close from {{ticks}} where {IN_CODES} group by trade_sec" for i, c in enumerate(CODES)),
    "close",
)
def p9(t: Tables) -> DataFrame:
    rows = t.ticks.groupBy("trade_sec", "stock_code").agg(F.max("close").alias("close"))
    return prices.panel(rows, ["close"], CODES, "trade_sec").select("trade_sec", F.posexplode("close").alias("place", "close"))


register("p10_adj_price", f"select trade_date, stock_code, close * adj_factor as adj_close from {newest('bars_versions', where=f'close is not null and {IN_CODES}')} x", "adj_close", 7)(
    lambda t: prices.daily(t.bars_versions, QueryFilter(codes=CODES)).select("trade_date", "stock_code", exprs.adjusted("close", "adj_factor", "forward").alias("adj_close"))
)
_agg = "arg_min(open, (trade_sec, event_id)) as open, max(high) as high, min(low) as low, arg_max(close, (trade_sec, event_id)) as close, cast(sum(volume) as bigint) as volume, sum(amount) as amount, sum(amount) / sum(volume) as vwap"
register("p11_bars_5min", f"select stock_code, trade_date, cast(trade_sec - trade_sec % 300 as bigint) as bar_sec, {_agg} from {{ticks}} group by all", "open high low close amount vwap", 5)(
    lambda t: prices.bars(t.ticks, 5).withColumn("bar_sec", F.col("bar_sec").cast("long"))
)
register("p12_daily_vwap", "select stock_code, trade_date, sum(amount) / sum(volume) as vwap from {ticks} group by all", "vwap")(lambda t: prices.bars(t.ticks).select("stock_code", "trade_date", "vwap"))

# --- F: factors; S: screening ------------------------------------------------------------------------------------


def wide_factors(t: Tables) -> DataFrame:
    return sinks.pivoted(t.factor_long, ["PE", "PB", "ROE"])


register("f1_routing", f"select trade_date, stock_code, 'PE' as factor_name, factor_value from {newest('factor_long', LONG, f'''factor_name = 'PE' and loaded_at <= timestamp '{AS_OF} 00:00:00' ''')} x", "factor_value")(
    lambda t: factors.factor("PE", t.factor_long, wide_factors(t), t.factor_long, as_of=AS_OF)
)
register("f2_factor", f"select trade_date, stock_code, factor_name, factor_value from {newest('factor_long', LONG, f'''factor_name = 'PE' and {IN_RANGE}''')} x", "factor_value")(lambda t: factors.factor("PE", t.factor_long, start=START, end=END))
register("f3_cross_section", f"select stock_code, factor_value from {PE_DAY} x", "factor_value")(lambda t: factors.cross_section("PE", DAY, t.factor_long))
_pivot = ", ".join(f"avg(case when factor_name = '{n}' then factor_value end) as {n}" for n in ("PE", "PB", "ROE"))
register("f4_factor_matrix", f"select trade_date, stock_code, {_pivot} from {newest('factor_long', LONG, IN_RANGE)} x group by trade_date, stock_code", "PE PB ROE")(lambda t: factors.factor_matrix(["PE", "PB", "ROE"], t.factor_long, start=START, end=END))
register("f5_factor_stats", f"select {stats('factor_value')} from {newest('factor_long', LONG, '''factor_name = 'PE' ''')} x", "mean std least most median", 5)(lambda t: factors.factor_stats("PE", t.factor_long))


def ic_sql(values: str, value: str) -> str:
    return f"""select trade_date, {corr('x', 'y')} as ic, count(*) as n from (
 select v.trade_date, cast(rank() over (partition by v.trade_date order by v.{value} nulls last) as double) as x,
 cast(rank() over (partition by v.trade_date order by p2.close / nullif(p1.close, 0) - 1 nulls last) as double) as y
 from {values} v join {BARS_NOW} p1 on p1.trade_date = v.trade_date and p1.stock_code = v.stock_code
 join (select trade_date, lead(trade_date) over (order by trade_date) as next_date from (select distinct trade_date from {BARS_NOW} z) q) d on d.trade_date = v.trade_date
 join {BARS_NOW} p2 on p2.trade_date = d.next_date and p2.stock_code = v.stock_code where v.{IN_RANGE}) r group by trade_date"""


register("f6_ic_series", ic_sql(newest("factor_long", LONG, "factor_name = 'PE'"), "factor_value"), "ic", 5)(
    lambda t: factors.ic_series(factors.factor("PE", t.factor_long, start=START, end=END), t.latest_bars().select("trade_date", "stock_code", "close"), 1, START, END)
)
register("f7_factor_names", "select distinct factor_name from {factor_long}")(lambda t: factors.factor_names(t.factor_long))
register(
    "f8_coverage",
    "select p.trade_date, n_priced, n_factor, cast(n_factor as double) / n_priced as coverage from (select trade_date, count(distinct stock_code) as n_priced from {bars} group by 1) p left join (select trade_date, count(distinct stock_code) as n_factor from {factor_long} where factor_name = 'ROE' group by 1) f on f.trade_date = p.trade_date",
    "coverage",
)(lambda t: factors.coverage("ROE", t.factor_long, t.bars))
_day = newest("factor_long", LONG, f"trade_date = date '{DAY}'")
register("s1_screen", f"select trade_date, stock_code, {_pivot} from {_day} x group by trade_date, stock_code having avg(case when factor_name = 'PE' then factor_value end) < 16 and avg(case when factor_name = 'PB' then factor_value end) > 1.2", "PE PB ROE")(
    lambda t: factors.screen(t.factor_long, DAY, ["PE < 16", "PB > 1.2"], "wide", ["PE", "PB", "ROE"])
)
register("s1_screen_long", f"select trade_date, stock_code, factor_name, factor_value from {_day} x where factor_name = 'PE' and factor_value < 16", "factor_value")(
    lambda t: factors.screen(t.factor_long, DAY, ["factor_name = 'PE'", "factor_value < 16"]).select("trade_date", "stock_code", "factor_name", "factor_value")
)
register(
    "s2_rank_by_factors",
    f"""select stock_code, cast(sum(r) as bigint) as score, count(distinct factor_name) as n_factors from (select stock_code, factor_name, rank() over (partition by factor_name order by round(factor_value * case factor_name when 'PE' then -1 else 1 end, 9)) as r
 from {_day} x where factor_name in ('PE', 'ROE')) q group by stock_code having count(distinct factor_name) = 2 order by score desc, stock_code limit 20""",
)(lambda t: factors.rank_by_factors(t.factor_long.withColumn("factor_value", F.round("factor_value", 9)), DAY, {"PE": -1, "ROE": 1}, 20))
register("s3_industry_distribution", f"select industry, count(*) as n, 100.0 * count(*) / sum(count(*)) over () as percent from {{stock_info}} where {IN_CODES} group by industry", "percent")(
    lambda t: factors.industry_distribution(t.stock_info, CODES)
)
register("s4_quantile_stocks", f"select stock_code, factor_value from {PE_DAY} x where round(factor_value, 9) >= (select quantile_cont(round(factor_value, 9), 0.7) from {PE_DAY} y)", "factor_value")(
    lambda t: factors.quantile_stocks(t.factor_long.withColumn("factor_value", F.round("factor_value", 9)), "PE", DAY, 0.3)
)

# --- M, A, O: macro, alternative, cross-source -------------------------------------------------------------------

_m = "trade_date, indicator_id, value_type, value"
_mc = [c.strip() for c in _m.split(",")]
register("m1_macro_data", f"select {_m} from {{macro_data}} where indicator_id in ('PMI', 'M2_yoy') and value_type = 'raw' and {IN_RANGE}", "value")(lambda t: macro.macro_data(t.macro_data, ["PMI", "M2_yoy"], START, END).select(*_mc))
_mm = ", ".join(f"max(case when indicator_id = '{i}' then value end) as {i}" for i in IDS)
register("m2_macro_matrix", f"select trade_date, {_mm} from {{macro_data}} where value_type = 'raw' group by trade_date", " ".join(IDS))(lambda t: macro.macro_matrix(t.macro_data, IDS))
register("m3_indicators", "select * from {macro_indicators} where category = 'price'")(lambda t: macro.indicators(t.macro_indicators, "price"))
register("m4_indicator_stats", f"select indicator_id, value_type, {stats('value')} from {{macro_data}} group by indicator_id, value_type", "mean std least most median")(lambda t: macro.indicator_stats(t.macro_data))
register("m5_latest_values", f"select {_m} from (select *, max(trade_date) over (partition by indicator_id) as last from {{macro_data}}) x where trade_date = last", "value")(lambda t: macro.latest_values(t.macro_data).select(*_mc))
register("m6_by_categories", f"select trade_date, m.indicator_id, value_type, value, category from {{macro_data}} m join {{macro_indicators}} i on m.indicator_id = i.indicator_id where category in ('activity', 'price') and {IN_RANGE}", "value")(
    lambda t: macro.by_categories(t.macro_data, t.macro_indicators, START, END, ["activity", "price"]).select(*_mc, "category")
)
register(
    "m7_year_on_year",
    "select trade_date, indicator_id, value, previous, (value - previous) / nullif(previous, 0) * 100 as yoy from (select *, lag(value, 12) over (partition by indicator_id order by trade_date) as previous from {macro_data} where value_type = 'raw') x where previous is not null",
    "value previous yoy",
)(lambda t: macro.year_on_year(t.macro_data))
register(
    "m8_macro_regime",
    f"select trade_date, case when PMI >= 50 and CPI_yoy >= 2 then '过热' when PMI >= 50 and CPI_yoy < 2 then '复苏' when PMI < 50 and CPI_yoy >= 2 then '滞胀' else '衰退' end as regime from (select trade_date, {_mm} from {{macro_data}} where value_type = 'raw' group by trade_date) x",
)(lambda t: macro.macro_regime(t.macro_data))
_a = "data_id, trade_date, data_subtype, entity_id, value"
_ac = [c.strip() for c in _a.split(",")]
register("a1_alternative", f"select {_a} from {{alternative_data}} where data_type = 'chain' and data_subtype = 'building' and entity_id = '01' and {IN_RANGE}", "value")(
    lambda t: macro.alternative(t.alternative_data, "chain", "building", entity_id="01", start=START, end=END).select(*_ac)
)
register("a2_chain_series", "select trade_date, data_id, value from {alternative_data} where data_type = 'chain' and entity_id = '00' and data_subtype = 'machinery'", "value")(lambda t: macro.time_series(t.alternative_data, "chain", "00", "machinery"))
register("a2_chain_data", f"select {_a} from {{alternative_data}} where data_type = 'chain' and data_subtype = 'household'", "value")(lambda t: macro.chain_data(t.alternative_data, subtype="household").select(*_ac))
register("a3_data_types", "select distinct data_type, entity_type from {alternative_data}")(lambda t: t.alternative_data.select("data_type", "entity_type").distinct().orderBy("data_type"))
register("a4_entities", "select distinct entity_type, entity_id from {alternative_data} where data_type = 'chain'")(lambda t: macro.entities(t.alternative_data, "chain"))
register("a5_latest", f"select {_a} from {{alternative_data}} where trade_date = (select max(trade_date) from {{alternative_data}} where data_subtype = 'building') and data_subtype = 'building'", "value")(
    lambda t: macro.latest_alternative(t.alternative_data, "chain", "building").select(*_ac)
)
register("a6_stats", f"select entity_id, {stats('value')} from {{alternative_data}} where data_type = 'chain' group by entity_id", "mean std least most median", 4)(lambda t: macro.alternative_stats(t.alternative_data, "chain"))
register(
    "a7_correlation_with_price",
    f"select data_subtype, stock_code, {corr('value', 'close')} as corr, count(*) as n from {{alternative_data}} a join {BARS_NOW} p on a.trade_date = p.trade_date - 5 where data_type = 'chain' and entity_id = '00' group by data_subtype, stock_code",
    "corr", 5,
)(lambda t: macro.correlation_with_price(t.alternative_data, t.latest_bars(), "chain", "00", 5))
register("o1_data_by_source", "select trade_date, value, 'alternative_data' as source_table, data_id, cast(null as varchar) as indicator_id from {alternative_data} where source_id = 'src_c' union all select trade_date, value, 'macro_data', null, indicator_id from {macro_data} where source_id = 'src_c'", "value")(
    lambda t: macro.data_by_source(t.macro_data, t.alternative_data, "src_c").select("trade_date", "value", "source_table", "data_id", "indicator_id")
)
register("o2_latest_macro", f"select trade_date, m.indicator_id, value_type, value, category from {{macro_data}} m left join {{macro_indicators}} i on m.indicator_id = i.indicator_id order by trade_date desc, m.indicator_id, value_type limit 25", "value")(
    lambda t: macro.latest_macro(t.macro_data, t.macro_indicators, limit=25).select(*_mc, "category")
)
register(
    "o3_cross_source",
    f"select coalesce(m.trade_date, f.trade_date) as trade_date, PMI, M2_yoy, PE, PB from (select trade_date, {_mm} from {{macro_data}} where value_type = 'raw' group by 1) m full join (select trade_date, {_pivot} from {newest('factor_long', LONG)} x where stock_code = '000001' group by 1) f on m.trade_date = f.trade_date",
    "PMI M2_yoy PE PB",
)(lambda t: macro.cross_source(t.macro_data, pit.latest(t.factor_long, factors.LONG_KEY), ["PMI", "M2_yoy"], ["PE", "PB"], "000001"))
register("o4_source_summary", "select coalesce(source_id, 'unknown') as source_id, count(*) as n, min(trade_date) as first_date, max(trade_date) as last_date, count(distinct indicator_id) as n_indicators from {macro_data} group by 1")(lambda t: macro.source_summary(t.macro_data))
register("o5_freshness", "select indicator_id, max(trade_date) as last_date, cast(date_diff('day', max(trade_date), date '2002-01-01') as int) as days_behind from {macro_data} group by 1")(lambda t: macro.freshness(t.macro_data, dt.date(2002, 1, 1)))
register("o6_routing", "select 'macro_data' as table_name, count(*) as n from {macro_data} union all select 'news_sentiment', count(*) from {news_sentiment} union all select 'report_sentiment', count(*) from {report_sentiment} union all select 'alternative_data', count(*) from {alternative_data}")(
    lambda t: ingest.combined([df.agg(F.lit(ingest.route(df)).alias("table_name"), F.count(F.lit(1)).alias("n")) for df in (t.macro_data, t.news_sentiment, t.report_sentiment, t.alternative_data)])
)
register("o8_json_rows", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from {events}")(lambda t: t.events.select("event_id", F.from_json("props", "k bigint").k.alias("k")))
register("o9_feed_rows", "select concat('rss_', substring(md5(concat(url, '')), 1, 16)) as news_id, url as title, 'neutral' as sentiment_label from {pages}")(
    lambda t: ingest.feed_rows(t.pages.select(F.col("url").alias("title"), F.lit("").alias("link"), F.lit("2024-01-01").alias("published")), "feed").select("news_id", "title", "sentiment_label")
)
register(
    "o10_policy_rows",
    """select page_id, cast(place as int) as place, trim(regexp_replace(element, '<[^>]*>', '', 'g')) as value_text, regexp_extract(element, 'href="([^"]*)"', 1) as url
 from (select page_id, unnest(els) as element, unnest(generate_series(0, len(els) - 1)) as place from (select page_id, regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a>')[1:20] as els from {pages}) e) x where length(trim(regexp_replace(element, '<[^>]*>', '', 'g'))) >= 5""",
)(lambda t: ingest.policy_rows(t.pages, START, classed=False).select("page_id", "place", "value_text", "url"))
register("o11_detected_columns", "select cast(o_orderdate as date) as trade_date, 'orders' as indicator_id, o_totalprice as value from {orders}", "value")(
    lambda t: ingest.detected(t.orders.select("o_orderkey", "o_orderdate", F.col("o_totalprice").alias("price_value")), "orders").select("trade_date", "indicator_id", "value")
)
register("o12_concat", "select trade_date, indicator_id, cast(null as varchar) as data_id, value from {macro_data} union all select trade_date, null, data_id, value from {alternative_data}", "value")(
    lambda t: ingest.combined([t.macro_data, t.alternative_data]).select("trade_date", "indicator_id", "data_id", "value")
)

# --- N: news -----------------------------------------------------------------------------------------------------

_n = "news_id, publish_date, sentiment_score, sentiment_label"
_nc = [c.strip() for c in _n.split(",")]
register("n1_stock_news", f"select {_n} from {{news_sentiment}} where '000007' in (stock_a, stock_b)", "sentiment_score")(lambda t: news.stock_news(t.news_sentiment, "000007").select(*_nc))
_na = "count(*) as n, avg(sentiment_score) as mean, stddev_samp(sentiment_score) as std, count(*) filter (where sentiment_label = 'positive') as n_positive, count(*) filter (where sentiment_label = 'negative') as n_negative, count(*) filter (where sentiment_label = 'neutral') as n_neutral"
register("n2_aggregation", f"select cast(date_trunc('week', publish_date) as date) as bucket, {_na} from {{news_sentiment}} where stock_a in ('000001', '000002', '000007') or stock_b in ('000001', '000002', '000007') group by 1", "mean std")(
    lambda t: news.aggregated(t.news_sentiment, CODES, freq="W")
)
register("n3_report_sentiment", "select report_id, publish_date, brokerage, sentiment_score from {report_sentiment} where related_stock = '000007'", "sentiment_score")(
    lambda t: news.report_sentiment(t.report_sentiment, "000007").select("report_id", "publish_date", "brokerage", "sentiment_score")
)
register("n4_sentiment_stocks", "select stock_code, avg(sentiment_score) as mean, count(*) as n from {news_stocks} where sentiment_label = 'positive' and publish_date = (select max(publish_date) from {news_sentiment}) group by 1", "mean")(
    lambda t: news.sentiment_stocks(t.news_sentiment, "positive", limit=None)
)
register("n5_trend", "select stock_code, publish_date, mean, avg(mean) over (partition by stock_code order by publish_date rows between 4 preceding and current row) as moving from (select stock_code, publish_date, avg(sentiment_score) as mean from {news_stocks} group by 1, 2) x", "mean moving")(
    lambda t: news.trend(t.news_sentiment)
)
register("n6_hot_news", "select news_id, publish_date, coalesce(read_count, 0) + 2 * coalesce(comment_count, 0) as hot from {news_sentiment} where publish_date = date '1998-01-15' order by hot desc, news_id limit 20")(
    lambda t: news.hot_news(t.news_sentiment, DAY).select("news_id", "publish_date", "hot")
)

# --- C: computation ----------------------------------------------------------------------------------------------

_w = "partition by stock_code order by trade_date"


def frame_sql(n: int) -> str:
    return f"over ({_w} rows between {n - 1} preceding and current row)"


def full_sql(agg: str, value: str, n: int) -> str:
    return f"case when count({value}) {frame_sql(n)} = {n} then {agg}({value}) {frame_sql(n)} end"


_RET = f"(select *, close / nullif(lag(close) over ({_w}), 0) - 1 as ret from {{bars}})"
register("c1_momentum", "select trade_date, stock_code, " + ", ".join(f"close / nullif(lag(close, {p}) over ({_w}), 0) - 1 as momentum_{p}" for p in (5, 10, 20)) + " from {bars}", "momentum_5 momentum_10 momentum_20")(
    lambda t: calc.momentum(t.bars).select("trade_date", "stock_code", "momentum_5", "momentum_10", "momentum_20")
)
register("c2_volatility", f"select trade_date, stock_code, {full_sql('stddev_samp', 'ret', 20)} as volatility from {_RET} x", "volatility")(lambda t: calc.volatility(t.bars).select("trade_date", "stock_code", "volatility"))
register("c3_turnover", f"select trade_date, stock_code, {full_sql('avg', 'turnover', 5)} as turnover_adj from {{bars}}", "turnover_adj")(lambda t: calc.turnover_adjusted(t.bars).select("trade_date", "stock_code", "turnover_adj"))
register("c4_volume_price_trend", f"select trade_date, stock_code, sum(m) over ({_w} rows unbounded preceding) as vpt from (select *, coalesce((volume - lag(volume) over ({_w})) * ret, 0) as m from {_RET} x) y", "vpt", 4)(
    lambda t: calc.volume_price_trend(t.bars).select("trade_date", "stock_code", "vpt")
)
_bb = f"avg(close) {frame_sql(20)} as m, stddev_samp(close) {frame_sql(20)} as s, count(close) {frame_sql(20)} as k"
register("c5_bollinger_position", f"select trade_date, stock_code, case when k = 20 then (close - (m - 2 * s)) / nullif(4 * s, 0) end as bollinger_position from (select *, {_bb} from {{bars}}) x", "bollinger_position")(
    lambda t: calc.bollinger_position(t.bars).select("trade_date", "stock_code", "bollinger_position")
)
register("c6_atr", f"select trade_date, stock_code, {full_sql('avg', 'tr', 14)} as atr from (select *, greatest(high - low, abs(high - lag(close) over ({_w})), abs(low - lag(close) over ({_w}))) as tr from {{bars}}) x", "atr", 5)(
    lambda t: calc.average_true_range(t.bars).select("trade_date", "stock_code", "atr")
)
register("c7_industry_neutral", "select b.trade_date, b.stock_code, pe - avg(pe) over (partition by industry, b.trade_date) as pe_neutral from {factor_values} b join {stock_info} i on b.stock_code = i.stock_code", "pe_neutral")(
    lambda t: calc.industry_neutral(t.factor_values.join(t.stock_info.select("stock_code", "industry"), "stock_code"), "pe", by=["trade_date"]).select("trade_date", "stock_code", "pe_neutral")
)
register(
    "c8_cap_neutral",
    """select trade_date, stock_code, case when n <= 2 then pe else pe - (my + coalesce(c / nullif(v, 0), 0) * (x - mx)) end as pe_cap_neutral from (select *, count(x) over w as n, covar_pop(x, pe) over w as c, var_pop(x) over w as v, avg(x) over w as mx, avg(pe) over w as my
 from (select f.trade_date, f.stock_code, pe, ln(amount) as x from {factor_values} f join {bars} b on f.trade_date = b.trade_date and f.stock_code = b.stock_code) q window w as (partition by trade_date)) z""",
    "pe_cap_neutral", 4,
)(lambda t: calc.cap_neutral(t.factor_values.join(t.bars.select("trade_date", "stock_code", "amount"), ["trade_date", "stock_code"]), "pe", "amount").select("trade_date", "stock_code", "pe_cap_neutral"))
register(
    "c9_all_factors",
    f"""select trade_date, stock_code, close / nullif(lag(close, 5) over ({_w}), 0) - 1 as momentum_5, close / nullif(lag(close, 20) over ({_w}), 0) - 1 as momentum_20, {full_sql('stddev_samp', 'ret', 20)} as volatility,
 case when k = 20 then (close - (m - 2 * s)) / nullif(4 * s, 0) end as bollinger_position, sum(coalesce(dv * ret, 0)) over ({_w} rows unbounded preceding) as vpt, {full_sql('avg', 'tr', 14)} as atr
 from (select *, {_bb}, volume - lag(volume) over ({_w}) as dv, greatest(high - low, abs(high - lag(close) over ({_w})), abs(low - lag(close) over ({_w}))) as tr from {_RET} x) y""",
    "momentum_5 momentum_20 volatility bollinger_position vpt atr", 4,
)(lambda t: calc.all_factors(t.bars).select("trade_date", "stock_code", "momentum_5", "momentum_20", "volatility", "bollinger_position", "vpt", "atr"))
register("c10_moving_averages", f"select trade_date, stock_code, avg(close) {frame_sql(5)} as ma_5, avg(close) {frame_sql(20)} as ma_20 from {{bars}}", "ma_5 ma_20", 4)(lambda t: calc.moving_averages(t.bars).select("trade_date", "stock_code", "ma_5", "ma_20"))
register(
    "c11_relative_strength",
    f"select trade_date, stock_code, 100 - 100 / (1 + avg(up) {frame_sql(14)} / (avg(down) {frame_sql(14)} + 1e-10)) as rsi from (select *, greatest(coalesce(close - lag(close) over ({_w}), 0), 0) as up, greatest(coalesce(lag(close) over ({_w}) - close, 0), 0) as down from {{bars}}) x",
    "rsi", 5,
)(lambda t: calc.relative_strength(t.bars).select("trade_date", "stock_code", "rsi"))


def ewm_sql(source: str, value: str, span: int, name: str, keep: str) -> str:
    """Weighted mean by positions of an ordered list per stock, back to where weights fall under 1e-12."""
    k, rows = 1 - 2 / (span + 1), 1
    while k**rows > 1e-12:
        rows += 1
    return f"""select {keep}, list_sum(list_transform(range(1, len(recent) + 1), lambda i: recent[i] * power({k!r}, len(recent) - i))) / list_sum(list_transform(range(1, len(recent) + 1), lambda i: power({k!r}, len(recent) - i))) as {name}
 from (select *, list({value}) over ({_w} rows between {rows - 1} preceding and current row) as recent from ({source}) s_{name}) r_{name}"""


_macd_rows = "select trade_date, stock_code, close from {bars}"
_fast = ewm_sql(_macd_rows, "close", 12, "fast", "trade_date, stock_code, close")
_slow = ewm_sql(_fast, "close", 26, "slow", "trade_date, stock_code, fast")
_signal = ewm_sql(f"select trade_date, stock_code, fast - slow as macd from ({_slow}) q", "macd", 9, "macd_signal", "trade_date, stock_code, macd")
register("c12_macd", f"select trade_date, stock_code, macd, macd_signal, macd - macd_signal as macd_hist from ({_signal}) z", "macd macd_signal macd_hist", 4)(
    lambda t: calc.macd(t.bars.select("trade_date", "stock_code", "close")).select("trade_date", "stock_code", "macd", "macd_signal", "macd_hist")
)
register("c13_bollinger_bands", f"select trade_date, stock_code, m as bb_middle, s as bb_std, m + 2 * s as bb_upper, m - 2 * s as bb_lower from (select *, {_bb} from {{bars}}) x", "bb_middle bb_std bb_upper bb_lower", 4)(
    lambda t: calc.bollinger_bands(t.bars).select("trade_date", "stock_code", "bb_middle", "bb_std", "bb_upper", "bb_lower")
)
_ohlc = "arg_min(open, trade_date) as open, max(high) as high, min(low) as low, arg_max(close, trade_date) as close, cast(sum(volume) as bigint) as volume, sum(amount) as amount"
register("c14_resample_month", f"select stock_code, cast(date_trunc('month', trade_date) + interval 1 month - interval 1 day as date) as period_end, {_ohlc} from {{bars}} group by 1, 2", "open high low close amount", 7)(lambda t: calc.resampled(t.bars, "M"))
register("c14_resample_week", f"select stock_code, cast(date_trunc('week', trade_date) + interval 6 day as date) as period_end, {_ohlc} from {{bars}} group by 1, 2", "open high low close amount", 7)(lambda t: calc.resampled(t.bars, "W"))
register("c15_filled_calendar", f"select stock_code, trade_date, last_value(close ignore nulls) over ({_w} rows unbounded preceding) as close from (select g.stock_code, g.trade_date, b.close from (select stock_code, trade_date from (select distinct stock_code from {{bars}}) s cross join (select trade_date from ({_calendar}) c) d) g left join {{bars}} b on b.stock_code = g.stock_code and b.trade_date = g.trade_date) x", "close", 7)(
    lambda t: calc.filled_calendar(t.bars)
)
_cw = ", ".join(f"max(case when stock_code = '{c}' then close end) as \"{c}\"" for c in CODES)
register("c16_long_to_wide", f"select trade_date, {_cw} from {{bars}} where {IN_CODES} group by trade_date", " ".join(f'"{c}"' for c in CODES), 7)(lambda t: calc.wide(t.bars, "close", CODES))
register("c16_wide_to_long", "select trade_date, stock_code, close from {bars}", "close", 7)(lambda t: matrix.unblocked(matrix.blocked(t.bars, ["close"], (d := matrix.places(t.bars))), ["close"], d))

# --- X: multi-source ---------------------------------------------------------------------------------------------

_pairs = "(select indicator_id, factor_name, m.trade_date, value as x, y from {macro_data} m join (select factor_name, trade_date, round(avg(factor_value), 12) as y from {factor_long} group by 1, 2) f on m.trade_date = f.trade_date where value_type = 'raw')"
register("x1_macro_factor_spearman", f"""select indicator_id, factor_name, count(*) as n, case when count(*) < 3 then 0 else {corr('rx', 'ry')} end as corr from (select indicator_id, factor_name,
 rank() over (partition by indicator_id, factor_name order by round(x, 9)) + (count(*) over (partition by indicator_id, factor_name, round(x, 9)) - 1) / 2.0 as rx, rank() over (partition by indicator_id, factor_name order by y) + (count(*) over (partition by indicator_id, factor_name, y) - 1) / 2.0 as ry from {_pairs} p) r group by 1, 2""", "corr", 5)(
    lambda t: fusion.macro_factor_correlation(t.macro_data.withColumn("value", F.round("value", 9)), t.factor_long, "spearman")
)
register("x2_macro_factor_matrix", f"select indicator_id, factor_name, count(*) as n, case when count(*) < 3 then 0 else {corr('x', 'y')} end as corr from {_pairs} p group by 1, 2", "corr", 5)(lambda t: fusion.macro_factor_correlation(t.macro_data, t.factor_long))
_z = ", ".join(f"case when count({i}) over w = 20 then ({i} - avg({i}) over w) / nullif(stddev_samp({i}) over w, 0) end as {i}" for i in IDS)
_zs = f"(select trade_date, {_z} from (select trade_date, {_mm} from {{macro_data}} where value_type = 'raw' group by trade_date) g window w as (order by trade_date rows between 19 preceding and current row))"
register("x3_macro_factor", f"select trade_date, (PMI + CPI_yoy + M2_yoy) / 3 as macro_factor from {_zs} z where PMI is not null and CPI_yoy is not null and M2_yoy is not null", "macro_factor", 5)(lambda t: fusion.macro_factor(t.macro_data, IDS))
register("x4_macro_factor_pca", None)(lambda t: fusion.macro_factor_pca(t.macro_data, IDS))
register("x5_regime_counts", f"select regime, count(*) as n from (select case when PMI >= 50 and CPI_yoy >= 2 then '过热' when PMI >= 50 and CPI_yoy < 2 then '复苏' when PMI < 50 and CPI_yoy >= 2 then '滞胀' else '衰退' end as regime from (select trade_date, {_mm} from {{macro_data}} where value_type = 'raw' group by trade_date) x) y group by regime")(
    lambda t: macro.macro_regime(t.macro_data).groupBy("regime").agg(F.count(F.lit(1)).alias("n"))
)
register(
    "x6_sector_sensitivity",
    """select industry, covar_pop(r, d) / nullif(var_pop(d), 0) as slope, count(*) as n from (select industry, trade_date, avg(r) as r from (select stock_code, trade_date, close / nullif(lag(close) over (partition by stock_code order by trade_date), 0) - 1 as r from (select stock_code, cast(date_trunc('month', trade_date) as date) as trade_date, arg_max(close, trade_date) as close from {bars} group by 1, 2) a) b join {stock_info} i using (stock_code) group by 1, 2) s
 join (select trade_date, value - lag(value) over (order by trade_date) as d from {macro_data} where indicator_id = 'PMI' and value_type = 'raw') m using (trade_date) where r is not null and d is not null group by industry""",
    "slope", 4,
)(lambda t: fusion.sector_sensitivity(t.bars, t.stock_info, t.macro_data, "PMI"))
register("x7_sentiment_factor", "select bucket, mean, n, avg(mean) over (order by bucket rows between 4 preceding and current row) as moving, mean - lag(mean) over (order by bucket) as change from (select publish_date as bucket, avg(sentiment_score) as mean, count(*) as n from {news_sentiment} group by 1) x", "mean moving change")(
    lambda t: news.sentiment_factor(t.news_sentiment)
)
register("x8_sentiment_signals", "select * from (select * from (select stock_code, avg(sentiment_score) as mean, count(*) as n from {news_stocks} where sentiment_label = 'positive' and publish_date = date '1998-01-15' group by 1) s order by mean desc, stock_code limit 20) q where n >= 2 order by mean desc, stock_code limit 10", "mean")(
    lambda t: news.sentiment_signals(t.news_sentiment, "positive", DAY)
)
register("x9_event_study", "select avg(case when publish_date < date '1998-01-15' then sentiment_score end) as before, avg(case when publish_date >= date '1998-01-15' then sentiment_score end) as after, count(*) as n, avg(case when publish_date >= date '1998-01-15' then sentiment_score end) - avg(case when publish_date < date '1998-01-15' then sentiment_score end) as change from {news_sentiment} where publish_date between date '1998-01-05' and date '1998-01-25' and '000007' in (stock_a, stock_b)", "before after change")(
    lambda t: news.event_study(t.news_sentiment, "000007", DAY)
)
_mood = "(select publish_date as trade_date, stock_code, avg(sentiment_score) as score from (select distinct news_id, publish_date, stock_code, sentiment_score from {news_stocks}) d group by 1, 2)"
register("x10_sentiment_ic", ic_sql(f"(select trade_date, stock_code, round(score, 9) as score from {_mood} md)", "score"), "ic", 5)(
    lambda t: factors.ic_series(
        t.news_sentiment.select(F.col("publish_date").alias("trade_date"), "sentiment_score", F.explode(F.array_distinct("related_stocks")).alias("stock_code")).groupBy("trade_date", "stock_code").agg(F.round(F.avg("sentiment_score"), 9).alias("factor_value")),
        t.latest_bars().select("trade_date", "stock_code", "close"), 1, START, END,
    )
)
_x11 = f"(select stock_code, 1 - (rank() over (order by factor_value) + (count(*) over (partition by factor_value) - 1) / 2.0) / count(*) over () as factor_score from {PE_FUSION} x)"
_x12 = "(select stock_code, (avg(sentiment_score) + 1) / 2 as sentiment_score from (select distinct news_id, publish_date, stock_code, sentiment_score from {news_stocks}) d where publish_date = date '1998-01-01' group by 1)"
_x13 = "(select case when max(value) is not null then greatest(0, least(1, 0.5 + (max(value) - 50) / 20)) end as macro_score from {macro_data} where indicator_id = 'PMI' and value_type = 'raw' and trade_date = date '1998-01-01')"
_x14 = "(select entity_id, greatest(0, least(1, (arg_min(value, data_id) - 3000) / 1000)) as alternative_score from {alternative_data} where trade_date = date '1998-01-01' group by 1)"
_x15 = f"(select stock_code, case when arg_min(close, trade_date) <> 0 then greatest(0, least(1, 0.5 + 10 * (arg_max(close, trade_date) / arg_min(close, trade_date) - 1))) end as price_score from {BARS_NOW} x where trade_date between date '1998-01-01' - 20 and date '1998-01-01' group by 1 having count(*) >= 5)"
_x16 = f"""select s.stock_code, coalesce(factor_score, 0.5) as factor_score, coalesce(sentiment_score, 0.5) as sentiment_score, coalesce(macro_score, 0.5) as macro_score, coalesce(alternative_score, 0.5) as alternative_score, coalesce(price_score, 0.5) as price_score,
 0.30 * coalesce(factor_score, 0.5) + 0.20 * coalesce(sentiment_score, 0.5) + 0.20 * coalesce(macro_score, 0.5) + 0.15 * coalesce(alternative_score, 0.5) + 0.15 * coalesce(price_score, 0.5) as total_score
 from {{stock_info}} s left join {_x11} a using (stock_code) left join {_x12} b using (stock_code) cross join {_x13} c left join {_x14} d on d.entity_id = substring(s.stock_code, 1, 2) left join {_x15} e using (stock_code)"""
_scores = "factor_score sentiment_score macro_score alternative_score price_score total_score"


def on_day(t: Tables) -> DataFrame:
    return between(t.news_sentiment, FUSION, FUSION, "publish_date")


def scores(t: Tables) -> DataFrame:
    return fusion.combined_score(t.stock_info, FUSION, t.pe(FUSION), on_day(t), t.macro_data, t.alternative_data, t.latest_bars())


register("x11_factor_score", f"select * from {_x11} x", "factor_score")(lambda t: fusion.factor_score(t.pe(FUSION)))
register("x12_sentiment_score", f"select * from {_x12} x", "sentiment_score")(lambda t: fusion.sentiment_score(on_day(t)))
register("x13_macro_score", f"select * from {_x13} x", "macro_score")(lambda t: fusion.macro_score(t.macro_data, FUSION))
register("x14_alternative_score", f"select entity_id as entity, alternative_score from {_x14} x", "alternative_score")(lambda t: fusion.alternative_score(t.alternative_data, FUSION))
register("x15_price_score", f"select * from {_x15} x", "price_score")(lambda t: fusion.price_score(t.latest_bars(), FUSION))
register("x16_combined_score", _x16, _scores, 9)(scores)
register("x17_screen", f"select * from ({_x16}) x where total_score >= 0.5 order by total_score desc, stock_code limit 50", _scores, 9)(lambda t: fusion.best_stocks(scores(t), 0.5))
register(
    "x18_source_panel",
    f"select s.stock_code, close, pe, sentiment, coalesce(n_news, 0) as n_news from {{stock_info}} s left join (select stock_code, close from {BARS_NOW} x where trade_date = date '1998-01-01') p using (stock_code) left join (select stock_code, factor_value as pe from {PE_FUSION} y) f using (stock_code) left join (select stock_code, avg(sentiment_score) as sentiment, count(*) as n_news from (select distinct news_id, publish_date, stock_code, sentiment_score from {{news_stocks}}) d where publish_date = date '1998-01-01' group by 1) m using (stock_code)",
    "close pe sentiment",
)(lambda t: fusion.source_panel(t.stock_info, FUSION, t.pe(FUSION), on_day(t), t.latest_bars()))

# --- L: loading --------------------------------------------------------------------------------------------------

_long_day = "select trade_date, stock_code, close from {bars}"


def landed_matrix(t: Tables) -> str:
    """The close of all stocks as text files of a year each, a header and a line a date."""
    path = f"{sinks.scratch(t.spark)}/matrix"
    lines = matrix.matrix_lines(t.bars, "close", matrix.places(t.bars))
    lines.repartition("year").sortWithinPartitions("year", F.desc("head"), "trade_date").select("year", "line").write.partitionBy("year").text(path)
    return path


register("l3_unpivot_matrix", _long_day, "close", 7)(lambda t: ingest.read_matrix(t.spark, landed_matrix(t)).withColumnRenamed("val", "close"))
register("l4_append_version", "select trade_date, stock_code, cast(null as double) as open, close from {bars}", "open close", 7)(
    lambda t: ingest.as_version(ingest.read_matrix(t.spark, landed_matrix(t)), "close", "2024-01-01")[1].select("trade_date", "stock_code", "open", "close")
)
register("p4_all_stocks", f"select trade_date, stock_code, close, volume from {BARS_NOW} x where {IN_RANGE}", "close", 7)(
    lambda t: matrix.unblocked(matrix.blocked(pit.latest(between(t.bars_versions, START, END), non_null=("close",)), ["close", "volume"], (d := matrix.places(t.stock_info))), ["close", "volume"], d)
)
_wide = "trade_date, stock_code, arg_max(factor_value, loaded_at) filter (where factor_name = 'PE') as PE, arg_max(factor_value, loaded_at) filter (where factor_name = 'PB') as PB"
register("l5_column_upsert", f"select coalesce(w.trade_date, n.trade_date) as trade_date, coalesce(w.stock_code, n.stock_code) as stock_code, coalesce(n.v, PE) as PE, PB from (select {_wide} from {{factor_long}} where factor_name in ('PE', 'PB') group by 1, 2) w full join (select trade_date, stock_code, 99.0 as v from {{bars}} where {IN_CODES}) n on w.trade_date = n.trade_date and w.stock_code = n.stock_code", "PE PB")(
    lambda t: sinks.with_column_upserted(sinks.pivoted(t.factor_long, ["PE", "PB"]).drop("loaded_at"), members(t.bars, CODES).select("trade_date", "stock_code", F.lit(99.0).alias("factor_value")), "PE")
)
register("l6_factor_columns", f"select 'PE' as field, count(PE) as n from (select {_wide} from {{factor_long}} group by 1, 2) w union all select 'PB', count(PB) from (select {_wide} from {{factor_long}} group by 1, 2) w2 union all select 'ROE', count(*) from (select distinct trade_date, stock_code from {{factor_long}} where factor_name = 'ROE') r union all select 'ROA', 0")(
    lambda t: (lambda wide: sinks.field_counts(wide, sinks.factor_columns(wide)))(sinks.with_factor_column(sinks.with_factor_column(wide_factors(t), "ROA"), "ROA"))
)
register("l7_pivot", f"select {_wide}, arg_max(factor_value, loaded_at) filter (where factor_name = 'ROE') as ROE, cast(max(loaded_at) as date) as loaded from {{factor_long}} group by 1, 2", "PE PB ROE")(
    lambda t: wide_factors(t).withColumn("loaded", F.to_date("loaded_at")).drop("loaded_at")
)
register("l8_unpivot", f"select trade_date, stock_code, factor_name, factor_value from {newest('factor_long', LONG)} x", "factor_value")(lambda t: sinks.unpivoted(wide_factors(t)))
register("l9_migration_counts", "select 'history' as part, count(*) as n from {factor_long} union all select 'wide', count(distinct (trade_date, stock_code)) from {factor_long}")(
    lambda t: ingest.combined([df.agg(F.lit(k).alias("part"), F.count(F.lit(1)).alias("n")) for k, df in zip(("wide", "history"), sinks.migrated(t.factor_long, ["PE", "PB", "ROE"], "2024-01-01"), strict=True)])
)
register("l11_level1_rows", "select trade_date, cast(trade_sec as int) as trade_sec, stock_code, open, volume from {ticks}", "open")(
    lambda t: ingest.level1_rows(t.level1.select(F.col("time_int").alias("time"), F.col("raw_code").alias("stock_code"), *(F.col("px").alias(c) for c in ("open", "high", "low", "close")), "volume", F.col("px").alias("amount"), "trade_date"), F.col("trade_date")).select("trade_date", "trade_sec", "stock_code", "open", "volume")
)
register("l13_loaded_range", "select min(trade_date) as first_date, max(trade_date) as last_date from {ticks}")(lambda t: prices.date_range(t.ticks))
register("l14_adj_factor_update", f"select v.trade_date, v.stock_code, cast(loaded_at as date) as loaded, coalesce(n.adj, adj_factor) as adj_factor from {{bars_versions}} v left join (select trade_date, stock_code, 2.0 as adj from {{bars}} where {IN_CODES}) n on n.trade_date = v.trade_date and n.stock_code = v.stock_code", "adj_factor")(
    lambda t: ingest.with_adj_factor(t.bars_versions, members(t.bars, CODES).select("trade_date", "stock_code", F.lit(2.0).alias("adj_factor"))).select("trade_date", "stock_code", F.to_date("loaded_at").alias("loaded"), "adj_factor")
)
register("l15_stock_table", "select coalesce(l.stock_code, i.stock_code) as stock_code, list_date, stock_name, industry from (select stock_code, min(trade_date) as list_date from {bars} group by 1) l full join {stock_info} i on i.stock_code = l.stock_code")(
    lambda t: ingest.stock_table(t.bars.groupBy("stock_code").agg(F.min("trade_date").alias("list_date")), t.stock_info.select("stock_code", "stock_name"), t.stock_info.select(F.lit(DAY).alias("trade_date"), "stock_code", "industry"))
)
_ends = "select trade_date, is_trading_day, is_trading_day and coalesce(date_trunc('month', trade_date) <> date_trunc('month', nxt), true) as is_month_end, is_trading_day and coalesce(date_trunc('quarter', trade_date) <> date_trunc('quarter', nxt), true) as is_quarter_end, is_trading_day and coalesce(date_trunc('year', trade_date) <> date_trunc('year', nxt), true) as is_year_end, cast(isodow(trade_date) - 1 as int) as week_day"
register("l16_trade_calendar", f"{_ends} from (select *, lead(trade_date) over (partition by is_trading_day order by trade_date) as nxt from ({_calendar}) c) x")(lambda t: ingest.trade_calendar(t.bars))
register("l17_suspend_flags", "select l_orderkey, l_partkey, l_suppkey, l_linenumber, case l_returnflag when 'R' then 0.0 end as val from {lineitem} where l_returnflag = 'R'", "val")(
    lambda t: ingest.suspend_flags(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_returnflag").alias("val")))
)
register("l18_nested_factors", f"select trade_date, concat('barra_tl_', factor_name) as factor_name, stock_code, factor_value from {newest('factor_long', LONG)} x where factor_name <> 'ROE'", "factor_value")(
    lambda t: ingest.exploded_factors(
        pit.latest(t.factor_long, factors.LONG_KEY).groupBy("trade_date", "factor_name").agg(F.map_from_entries(F.collect_list(F.struct("stock_code", "factor_value"))).alias("codes")).groupBy("trade_date").agg(F.map_from_entries(F.collect_list(F.struct("factor_name", "codes"))).alias("factors")),
        skip=("ROE",),
    )
)
register("l19_not_loaded", "select distinct factor_name from {factor_long} where factor_name <> 'PE'")(lambda t: sinks.not_loaded(t.factor_long, t.factor_long.filter("factor_name = 'PE'")))
register("l19_field_counts", "select 'open' as field, count(open) as n from {bars_versions} union all select 'adj_factor', count(adj_factor) from {bars_versions}")(lambda t: sinks.field_counts(t.bars_versions, ["open", "adj_factor"]))
register("l20_without_names", "select trade_date, stock_code, factor_name, factor_value from {factor_long} where factor_name not in ('PB', 'ROE')", "factor_value")(lambda t: sinks.without_names(t.factor_long, ["PB", "ROE"]).select("trade_date", "stock_code", "factor_name", "factor_value"))
_vendor = lambda t: t.bars.select(F.col("stock_code").alias("Stkcd"), F.col("trade_date").cast("string").alias("Trddt"), F.col("high").cast("string").alias("hi"), F.col("low").cast("string").alias("lo"))
register("l21_vendor_rows", "select stock_code, trade_date, high as hi, low as lo from {bars}", "hi lo", 7)(lambda t: ingest.vendor_rows(_vendor(t)))
register("l22_vendor_factors", "select trade_date, stock_code, 'rng_hi' as factor_name, high as factor_value from {bars} union all select trade_date, stock_code, 'rng_lo', low from {bars}", "factor_value", 7)(
    lambda t: ingest.vendor_factors(ingest.vendor_rows(_vendor(t)), "rng", "2024-01-01").drop("loaded_at")
)
register("l23_market_factors", "select trade_date, 'MARKET' as stock_code, 'PMI' as factor_name, value as factor_value from {macro_data} where indicator_id = 'PMI' and value_type = 'raw'", "factor_value")(
    lambda t: ingest.vendor_factors(macro.macro_data(t.macro_data, ["PMI"]).select("trade_date", "value"), "PMI", "2024-01-01", market=True).drop("loaded_at")
)
register("l25_macro_replace", "select trade_date, indicator_id, value_type, case when indicator_id = 'PMI' and value_type = 'raw' then 1.0 else value end as value from {macro_data}", "value")(
    lambda t: sinks.replaced_by_key(ingest.macro_rows(t.macro_data), ingest.macro_rows(t.macro_data.filter("indicator_id = 'PMI' and value_type = 'raw'").select(F.col("trade_date").alias("date"), F.col("indicator_id").alias("indicator"), F.lit(1.0).alias("val"))), ("trade_date", "indicator_id", "value_type")).select(*_mc)
)
register("l26_indicator_upsert", "select indicator_id, category from {macro_indicators} union all select distinct p_brand, 'brand' from {part}")(
    lambda t: sinks.ignored_if_exists(
        t.macro_indicators,
        t.part.select(F.col("p_brand").alias("indicator_id"), F.lit("brand").alias("category")).union(t.macro_data.select("indicator_id", F.lit("ignored"))),
        ("indicator_id",),
    ).select("indicator_id", "category")
)
register("l27_news_rows", "select news_id, publish_date, title, stock_a as first_stock, stock_b as second_stock from {news_sentiment}")(
    lambda t: ingest.news_rows(t.news_sentiment.select(F.col("news_id").alias("id"), F.col("publish_date").alias("date"), "title", F.array_join("related_stocks", " , ").alias("stocks"))).select("news_id", "publish_date", "title", F.col("related_stocks")[0].alias("first_stock"), F.col("related_stocks")[1].alias("second_stock"))
)
register("l28_report_rows", "select report_id, publish_date, title, related_stock, sentiment_score from {report_sentiment}", "sentiment_score")(
    lambda t: ingest.report_rows(t.report_sentiment.select(F.col("report_id").alias("id"), F.col("publish_date").alias("date"), "title", F.col("related_stock").alias("stock"), "sentiment_score")).select("report_id", "publish_date", "title", "related_stock", "sentiment_score")
)
register("l29_alternative_rows", "select concat('chain_', data_subtype, '_', entity_id, '_', cast(trade_date as varchar)) as data_id, trade_date, data_type, data_subtype, entity_id, value, 100 as data_quality from {alternative_data}", "value")(
    lambda t: ingest.alternative_rows(t.alternative_data.select(F.col("trade_date").alias("date"), F.col("data_subtype").alias("subtype"), F.col("entity_id").alias("entity"), F.col("value").alias("val")), "chain").select("data_id", "trade_date", "data_type", "data_subtype", "entity_id", "value", "data_quality")
)
register("l32_table_stats", "select 'bars' as table_name, count(*) as n_rows, 10 as n_columns from {bars} union all select 'macro_data', count(*), 6 from {macro_data}")(lambda t: sinks.table_stats({"bars": t.bars, "macro_data": t.macro_data}))
register("l33_load_summary", "select count(*) as n_rows, count(distinct trade_date) as n_days, count(distinct stock_code) as n_stocks, min(trade_date) as first_date, max(trade_date) as last_date, count(distinct factor_name) as n_names from {factor_long}")(lambda t: sinks.load_summary(t.factor_long, "factor_name"))
register("l33_rows_by_year", "select cast(extract(year from trade_date) as int) as year, count(*) as n from {bars} group by 1")(lambda t: sinks.rows_by_year(t.bars))
register("l33_top_names", "select factor_name, count(*) as n from {factor_long} group by 1 order by n desc, factor_name limit 20")(lambda t: sinks.top_names(t.factor_long))

# --- V: checks; T: batch forms of the streams --------------------------------------------------------------------

_bad = lambda t: t.bars.withColumn("high", F.when(F.col("volume") % 7 == 0, F.col("low") - 1).otherwise(F.col("high")))
_badsql = "(select *, case when volume % 7 = 0 then low - 1 else high end as h from {bars})"
register("v1_missing_columns", "select 'adj' as column_name, count(*) as n_rows, count(*) = 0 as is_empty from {bars}")(
    lambda t: t.bars.agg(F.count(F.lit(1)).alias("n_rows")).select(F.explode(F.array(*map(F.lit, checks.missing_columns(t.bars, ["close", "adj"])))).alias("column_name"), "n_rows", (F.col("n_rows") == 0).alias("is_empty"))
)
register("v2_price_checks", f"select 'high_below_others' as \"check\", 'warning' as severity, count(*) filter (where h < low or h < open or h < close) as n from {_badsql} a union all select 'low_above_others', 'warning', count(*) filter (where low > open or low > close) from {_badsql} b union all select 'negative_price', 'error', count(*) filter (where open < 0 or h < 0 or low < 0 or close < 0) from {_badsql} c union all select 'negative_volume', 'error', count(*) filter (where volume < 0) from {_badsql} d")(
    lambda t: checks.price_checks(_bad(t))
)
register("v3_factor_checks", "select 'empty_name' as \"check\", 'error' as severity, count(*) filter (where factor_name = 'PB') as n from {factor_long} union all select 'infinite_value', 'error', 0 from (select 1) q union all select 'not_a_number', 'error', 0 from (select 1) z")(
    lambda t: checks.factor_checks(t.factor_long.withColumn("factor_name", F.when(F.col("factor_name") == "PB", " ").otherwise(F.col("factor_name"))))
)
register("v4_level1_checks", "select 'bad_time' as \"check\", 'error' as severity, count(*) filter (where event_id % 13 = 0) as n from {level1} union all select 'negative_price', 'error', count(*) filter (where px < 0) from {level1} union all select 'no_volume', 'warning', count(*) filter (where volume <= 0) from {level1}")(
    lambda t: checks.level1_checks(t.level1.withColumn("time_int", F.when(F.col("event_id") % 13 == 0, 250000).otherwise(F.col("time_int"))))
)
register("v5_code_checks", "select 'bad_code' as \"check\", 'error' as severity, count(*) filter (where industry_code % 5 = 0) as n from {stock_info} union all select 'wrong_exchange', 'warning', count(*) filter (where industry_code % 5 = 1) from {stock_info}")(
    lambda t: checks.code_checks(t.stock_info.withColumn("stock_code", F.when(F.col("industry_code") % 5 == 0, "12").when(F.col("industry_code") % 5 == 1, F.concat("stock_code", F.lit(".SH"))).otherwise(F.col("stock_code"))))
)
register("v6_null_share", 'select \'close\' as "column", count(*) filter (where close is null) / cast(count(*) as double) as share, false as "over" from {bars_versions} union all select \'adj_factor\', 0, false from (select 1) q', "share")(
    lambda t: checks.null_share(t.bars_versions, ["close", "adj_factor"], 0.8)
)

# --- queries that write and read back --------------------------------------------------------------------------

def written(t: Tables, df: DataFrame, kind: str = "parquet") -> str:
    path = f"{sinks.scratch(t.spark)}/table"
    df.write.option("header", "true").format(kind).save(path)
    return path


_values = "trade_date, stock_code, pe, pb, roe"
for _kind in ("csv", "json", "parquet"):
    register(f"l1_{_kind}_source", f"select {_values} from {{factor_values}}", "pe pb roe")(
        lambda t, kind=_kind: ingest.read(t.spark, written(t, t.factor_values, kind), kind, "trade_date date, stock_code string, pe double, pb double, roe double")
    )


def fields_written(t: Tables, kind: str) -> str:
    """One table a field, in folders by category: valuation/pe, valuation/pb, quality/roe."""
    root, values = sinks.scratch(t.spark), t.spark.read.parquet(written(t, t.factor_values))  # computed once
    for category, name in (("valuation", "pe"), ("valuation", "pb"), ("quality", "roe")):
        rows = values.select("trade_date", "stock_code", F.col(name).alias("val"))
        rows.write.option("header", "true").format(kind).save(f"{root}/{category}/{name}.{kind}")
    return root


_field = "select '{c}' as category, '{f}' as field, trade_date, stock_code, {f} as val from {{factor_values}}"
_fields_sql = " union all ".join(_field.replace("{c}", c).replace("{f}", f).replace("{{", "{").replace("}}", "}") for c, f in (("valuation", "pe"), ("valuation", "pb"), ("quality", "roe")))
for _name, _kind in (("l2_directory_fields", "parquet"), ("l24_directory_categories", "csv")):
    register(_name, _fields_sql, "val")(
        lambda t, kind=_kind: ingest.read_fields(t.spark, fields_written(t, kind), kind, "trade_date date, stock_code string, val double").select("category", "field", "trade_date", "stock_code", "val")
    )


@register("l10_compatibility_view", f"select trade_date, stock_code, factor_name, factor_value from {newest('factor_long', LONG)} x", "factor_value")
def l10(t: Tables) -> DataFrame:
    sinks.compatibility_view(wide_factors(t), "factor_data_view")
    return t.spark.sql("select trade_date, stock_code, factor_name, factor_value from factor_data_view")


_tick_rows = "select event_id, trade_date, cast(trade_sec as bigint) as trade_sec, stock_code, close, volume from {ticks}"


@register("l12_partitioned_sink", _tick_rows, "close")
def l12(t: Tables) -> DataFrame:
    """The first half of the days, then all, then all again: a day that is there is not written twice."""
    rows = t.ticks.select("event_id", "trade_date", F.col("trade_sec").cast("long").alias("trade_sec"), "stock_code", "close", "volume")
    path = f"{sinks.scratch(t.spark)}/ticks"
    middle = rows.agg(F.percentile(F.datediff("trade_date", F.lit("1970-01-01")), 0.5).alias("m"))  # one row
    first = rows.join(F.broadcast(middle), F.datediff("trade_date", F.lit("1970-01-01")) <= F.col("m"), "left_semi")
    sinks.append_new_dates(first, path, None)
    for _ in range(2):
        sinks.append_new_dates(rows, path, t.spark.read.parquet(path))
    return t.spark.read.parquet(path).select(*rows.columns)


@register("l13_days_not_loaded", _tick_rows.replace("from {ticks}", "from {ticks} where extract(day from trade_date) % 2 = 1"), "close")
def l13(t: Tables) -> DataFrame:
    """The rows that a load would add to a table that holds the even days."""
    rows = t.ticks.select("event_id", "trade_date", F.col("trade_sec").cast("long").alias("trade_sec"), "stock_code", "close", "volume")
    return sinks.new_dates(rows, rows.filter(F.day("trade_date") % 2 == 0))


register("l9_migrated_wide", f"select {_wide}, arg_max(factor_value, loaded_at) filter (where factor_name = 'ROE') as ROE from {{factor_long}} group by 1, 2", "PE PB ROE")(
    lambda t: sinks.migrated(t.factor_long, ["PE", "PB", "ROE"], "2024-01-01")[0].select("trade_date", "stock_code", "PE", "PB", "ROE")
)
register("l9_migrated_history", "select trade_date, stock_code, factor_name, factor_value, cast(loaded_at as date) as loaded from {factor_long}", "factor_value")(
    lambda t: sinks.migrated(t.factor_long, ["PE", "PB", "ROE"], "2024-01-01")[1].withColumn("loaded", F.to_date("loaded_at")).drop("loaded_at")
)
register("l30_registered_types", "select data_subtype as data_type, case when data_subtype like 'b%' then 'new' else 'old' end as type_name, count(*) as n from {alternative_data} group by 1")(
    lambda t: sinks.replaced_by_key(
        t.alternative_data.groupBy(F.col("data_subtype").alias("data_type")).agg(F.lit("old").alias("type_name"), F.count(F.lit(1)).alias("n")),
        t.alternative_data.filter("data_subtype like 'b%'").groupBy(F.col("data_subtype").alias("data_type")).agg(F.lit("new").alias("type_name"), F.count(F.lit(1)).alias("n")),
        ("data_type",),
    )
)


@register("l31_active_sources", "select source_id, count(*) as n from {macro_data} where source_id <> 'src_b' group by source_id union all select unnest(['tushare', 'akshare', 'eastmoney', 'sina']), 0")
def l31_sources(t: Tables) -> DataFrame:
    """Default sources and those of the macro table, of which one is switched off, with the rows that each has."""
    seen = t.macro_data.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    given = seen.select("source_id", (F.col("source_id") != "src_b").alias("is_active"))
    active = ingest.active_sources(sinks.replaced_by_key(ingest.default_metadata(t.spark)[1].select("source_id", "is_active"), given, ("source_id",)))
    return active.join(seen, "source_id", "left").select("source_id", F.coalesce("n", F.lit(0)).alias("n"))


register("l31_fields_of_category", "select p_partkey as field_id, p_name as field_name from {part} where p_brand = 'Brand#1' or p_brand = 'Brand#11'")(
    lambda t: ingest.fields_of(t.part.select(F.col("p_partkey").alias("field_id"), F.replace("p_brand", F.lit("Brand#11"), F.lit("Brand#1")).alias("category_id"), F.col("p_name").alias("field_name")), "Brand#1").select("field_id", "field_name")
)


@register("l34_recompressed", "select trade_date, stock_code, factor_name, factor_value from {factor_long}", "factor_value")
def l34(t: Tables) -> DataFrame:
    path, _ = sinks.recompressed(t.spark, written(t, t.factor_long), sinks.scratch(t.spark), ["stock_code", "trade_date"])
    return t.spark.read.parquet(path).select("trade_date", "stock_code", "factor_name", "factor_value")


@register("o7_ingest_outcome", "select 'macro' as source, 'macro_data' as table_name, count(*) as n from {macro_data} union all select 'news', 'news_sentiment', count(*) from {news_sentiment} union all select 'none', 'macro_data', 0 union all select 'odd', null, -1")
def o7(t: Tables) -> DataFrame:
    """Three sources that are stored, one of them without rows, and one that belongs to no table."""
    news_in = t.news_sentiment.select("news_id", "publish_date", "title", F.array_join("related_stocks", ",").alias("stocks"))
    sources = {"macro": t.macro_data, "news": news_in, "none": t.macro_data.filter("value is null"), "odd": t.part}
    done = ingest.ingest(sources, lambda name, rows: t.spark.read.parquet(written(t, rows)), "2024-01-01")
    return done.select("source", "table_name", "n")


register("o8_world_rows", "select cast(date_trunc('year', trade_date) as date) as trade_date, 'POPULATION' as indicator_id, cast(n as double) as value, 'worldbank' as source_id from {macro_months}", "value")(
    lambda t: ingest.world_rows(
        t.macro_months.select(
            F.format_string('[{"page": 1}, [{"indicator": {"id": "SP.POP.TOTL", "value": "Population"}, "date": "%d", "value": %d}, {"indicator": {"id": "XX", "value": "Other"}, "date": "%d", "value": null}]]', F.year("trade_date"), "n", F.year("trade_date")).alias("json")
        )
    ).select("trade_date", "indicator_id", "value", "source_id")
)


# --- paths of operators that the queries above do not take --------------------------------------------------------

register("f1_wide_route", "select trade_date, stock_code, 'PE' as factor_name, arg_max(factor_value, loaded_at) as factor_value from {factor_long} where factor_name = 'PE' group by 1, 2", "factor_value")(
    lambda t: factors.factor("PE", t.factor_long, wide_factors(t), t.factor_long)
)
_roe = newest("factor_long", LONG, "factor_name = 'ROE'")
register("f1_long_route", f"select trade_date, stock_code, factor_name, factor_value from {_roe} x", "factor_value")(lambda t: factors.factor("ROE", t.factor_long, sinks.pivoted(t.factor_long, ["PE", "PB"])))
register("o3_without_stock", "select trade_date, indicator_id, value from {macro_data} where indicator_id in ('PMI', 'M2_yoy') and value_type = 'raw'", "value")(
    lambda t: macro.cross_source(t.macro_data, t.factor_long, ["PMI", "M2_yoy"], [])
)


def classed_pages(t: Tables) -> DataFrame:
    """The pages, with a class on list items and on links, as policy sites have them."""
    return t.pages.withColumn("html", F.replace(F.replace("html", F.lit("<li>"), F.lit('<li class="x">')), F.lit("<a href"), F.lit('<a class="y" href')))


register(
    "o10_classed_elements",
    r"""select page_id, cast(place as int) as place, trim(regexp_replace(element, '<[^>]*>', '', 'g')) as value_text from (select page_id, unnest(els) as element, unnest(generate_series(0, len(els) - 1)) as place
 from (select page_id, regexp_extract_all(replace(replace(html, '<li>', '<li class="x">'), '<a href', '<a class="y" href'), '(?is)<a\b[^>]*?class\s*=[^>]*>.*?</a>|<li\b[^>]*?class\s*=[^>]*>.*?</li>')[1:20] as els from {pages}) e) x
 where length(trim(regexp_replace(element, '<[^>]*>', '', 'g'))) >= 5""",
)(lambda t: ingest.policy_rows(classed_pages(t), START).select("page_id", "place", "value_text"))
register(
    "l14_adj_factor_version",
    f"select trade_date, stock_code, cast(loaded_at as date) as loaded, close, adj_factor from {{bars_versions}} union all select trade_date, stock_code, date '2024-01-01', close, 2.0 from {newest('bars_versions')} v where {IN_CODES}",
    "close adj_factor", 7,
)(
    lambda t: ingest.with_adj_factor(t.bars_versions, members(t.bars, CODES).select("trade_date", "stock_code", F.lit(2.0).alias("adj_factor")), "2024-01-01").select("trade_date", "stock_code", F.to_date("loaded_at").alias("loaded"), "close", "adj_factor")
)


@register("l20_deleted_factors", "select trade_date, stock_code, factor_name, factor_value from {factor_long} where factor_name not in ('PB', 'ROE')", "factor_value")
def l20_deleted(t: Tables) -> DataFrame:
    """A stored long table from which two factors were deleted, twice."""
    path = stored_months(t, t.factor_long)
    for _ in range(2):
        stored.delete_factors(t.spark, path, ["PB", "ROE"])
    return t.spark.read.parquet(path).select("trade_date", "stock_code", "factor_name", "factor_value")


_week = "cast(date_trunc('week', trade_date) + interval 6 day as date)"
register(
    "c14_resample_empty",
    f"""select g.stock_code, g.period_end, open, high, low, close, coalesce(volume, 0) as volume, coalesce(amount, 0) as amount
 from (select stock_code, cast(unnest(generate_series(min({_week}), max({_week}), interval 7 day)) as date) as period_end from {{bars}} group by 1) g
 left join (select stock_code, {_week} as period_end, {_ohlc.replace("arg_max(close, trade_date) as close", "avg(close) as close")} from {{bars}} group by 1, 2) r on r.stock_code = g.stock_code and r.period_end = g.period_end""",
    "open high low close amount", 7,
)(lambda t: calc.resampled(t.bars, "W", empty=True, close="mean"))

# --- stored tables: written in parts and read back ---------------------------------------------------------------


def stored_months(t: Tables, df: DataFrame) -> str:
    """A table of versions in folders by month, sorted as loaded."""
    path = f"{sinks.scratch(t.spark)}/months"
    stored.with_month(df).repartition("month").sortWithinPartitions("month", "stock_code", "trade_date").write.partitionBy("month").parquet(path)
    return path


_compacted = f"(select *, max(case when loaded_at < timestamp '{AS_OF} 00:00:00' then loaded_at end) over (partition by trade_date, stock_code) as old from {{bars_versions}})"
_stays = f"(loaded_at >= timestamp '{AS_OF} 00:00:00' or loaded_at = old)"
register(
    "b8_compacted_partitions",
    f"select cast(date_trunc('month', trade_date) as date) as month, count(*) filter (where {_stays}) as n_kept, count(*) filter (where not {_stays}) as n_dropped from {_compacted} x group by 1 having count(*) filter (where not {_stays}) > 0",
)(lambda t: stored.compact_table(t.spark, stored_months(t, t.bars_versions), AS_OF))


@register("b8_compacted_table", f"select {_versions} from {_compacted} x where {_stays}", BAR.replace("volume, ", ""), 7)
def b8_table(t: Tables) -> DataFrame:
    """The stored table after compaction, and after another that finds nothing to do."""
    path = stored_months(t, t.bars_versions)
    for _ in range(2):
        stored.compact_table(t.spark, path, AS_OF)
    return _loaded(t.spark.read.parquet(path))


def dual_written(t: Tables) -> str:
    """Two factors stored one after the other, then an update of one for some stocks in a few months, twice."""
    root = sinks.scratch(t.spark)
    day = lambda name: t.factor_values.select("trade_date", "stock_code", F.col(name).alias("factor_value"))
    stored.store_factor(t.spark, root, day("pe"), "PE", "2024-01-01 00:00:00")
    stored.store_factor(t.spark, root, between(day("pb"), START), "PB", "2024-01-02 00:00:00")
    for _ in range(2):
        stored.store_factor(t.spark, root, members(between(day("roe"), START, END), CODES), "PE", "2024-01-03 00:00:00")
    return root


_updated = f"{IN_CODES} and {IN_RANGE}"
register("l5_dual_write_wide", f"select trade_date, stock_code, case when {_updated} then roe else pe end as PE, case when trade_date >= date '{START}' then pb end as PB from {{factor_values}}", "PE PB", 7)(
    lambda t: stored.stored_wide(t.spark, dual_written(t)).select("trade_date", "stock_code", "PE", "PB")
)
register(
    "l5_dual_write_history",
    f"select trade_date, stock_code, 'PE' as factor_name, pe as factor_value, 1 as day from {{factor_values}} union all select trade_date, stock_code, 'PB', pb, 2 from {{factor_values}} where trade_date >= date '{START}' union all select trade_date, stock_code, 'PE', roe, 3 from {{factor_values}} where {_updated}",
    "factor_value", 7,
)(lambda t: stored.stored_history(t.spark, dual_written(t)).withColumn("day", F.day("loaded_at")).drop("loaded_at"))


def stored_ticks(t: Tables) -> DataFrame:
    """Ticks in folders by date, read back."""
    path = f"{sinks.scratch(t.spark)}/ticks"
    sinks.append_new_dates(t.ticks.withColumn("trade_sec", F.col("trade_sec").cast("long")), path, None)
    return t.spark.read.parquet(path)


_fields = ("event_id", "trade_date", "trade_sec", "stock_code", "close", "volume", "amount")
register("p2_level1_partitioned", f"select {_tick} from {{ticks}} where trade_date = date '2024-01-03' and trade_sec between 36000 and 37800", "close amount")(
    lambda t: prices.level1(stored_ticks(t), (), dt.date(2024, 1, 3), 36000, 37800, _fields)
)
register("p2_month_end_ticks", f"select {_tick} from {{ticks}} where trade_date in (select max(trade_date) from {{ticks}} group by date_trunc('month', trade_date))", "close amount")(
    lambda t: (lambda ticks: prices.level1_of(ticks, ingest.trade_calendar(t.ticks).filter("is_month_end"), _fields))(stored_ticks(t))
)


def rolled_partials(t: Tables) -> DataFrame:
    """Partial bars of three batches: most ticks, late ones, and the late ones again."""
    root = f"{sinks.scratch(t.spark)}/partials"
    late = F.col("event_id") % 7 == 3
    stored.store_partials(t.ticks.filter(~late), root, "day")
    for _ in range(2):
        stored.store_partials(t.ticks.filter(late), root, "late")
    return stored.stored_partials(t.spark, root)


_bars = f"{_agg}, count(*) as n_ticks"
register("p11_rolled_day", f"select stock_code, trade_date, {_bars} from {{ticks}} group by all", "open high low close amount vwap", 5)(lambda t: stored.merged_bars(rolled_partials(t)))
register("p11_rolled_hour", f"select stock_code, trade_date, cast(trade_sec - trade_sec % 3600 as bigint) as bar_sec, {_bars} from {{ticks}} group by all", "open high low close amount vwap", 5)(
    lambda t: stored.merged_bars(rolled_partials(t), 60).withColumn("bar_sec", F.col("bar_sec").cast("long"))
)


def logged_runs(t: Tables) -> str:
    """Two runs: in the first the news are broken, in the second all are whole and only these two tables are run."""
    root = sinks.scratch(t.spark)
    news_in = t.news_sentiment.select("news_id", "publish_date", "title", F.array_join("related_stocks", ",").alias("stocks"))
    broken = news_in.withColumn("publish_date", F.raise_error(F.lit("feed is down")).cast("date"))
    macro_in = t.macro_data.select("trade_date", "indicator_id", "value", "value_type")
    ingest.stored_run({"macro": macro_in, "news": broken, "none": macro_in.filter("value is null"), "odd": t.part}, root, "r1", "2024-01-01")
    ingest.stored_run({"macro": macro_in.filter("indicator_id = 'PMI'"), "news": news_in, "odd": t.part}, root, "r2", "2024-01-02", ("macro_data", "news_sentiment"))
    return root


register(
    "o7_ingest_log",
    """select 'macro' as source, 'macro_data' as table_name, count(*) as n, 'r1' as run, false as failed from {macro_data} union all select 'news', 'news_sentiment', -1, 'r1', true union all select 'none', 'macro_data', 0, 'r1', false
 union all select 'odd', null, -1, 'r1', true union all select 'macro', 'macro_data', count(*), 'r2', false from {macro_data} where indicator_id = 'PMI' union all select 'news', 'news_sentiment', count(*), 'r2', false from {news_sentiment}""",
)(lambda t: ingest.ingest_log(t.spark, logged_runs(t)).select("source", "table_name", "n", "run", F.col("error").isNotNull().alias("failed")))
register(
    "o7_ingest_status",
    """select 'macro' as source, count(*) filter (where indicator_id = 'PMI') as last_n, 2 as last_run, 2 as last_success, 2 as n_runs, 0 as n_failed, count(*) + count(*) filter (where indicator_id = 'PMI') as n_stored from {macro_data}
 union all select 'news', count(*), 2, 2, 2, 1, count(*) from {news_sentiment} union all select 'none', 0, 1, 1, 1, 0, 0 union all select 'odd', -1, 1, null, 1, 1, 0""",
)(lambda t: ingest.ingest_status(t.spark, logged_runs(t)).withColumns({c: F.day(c) for c in ("last_run", "last_success")}))
register("o7_stored_rows", "select trade_date, indicator_id, value_type, value from {macro_data}", "value")(
    lambda t: ingest.stored_rows(t.spark, logged_runs(t), "macro_data").select("trade_date", "indicator_id", "value_type", "value")
)


@register("l21_vendor_files", "select stock_code, trade_date, high as hi, case when extract(year from trade_date) % 2 = 0 then low end as lo from {bars}", "hi lo", 7)
def l21_files(t: Tables) -> DataFrame:
    """Vendor files of a month each, with two lines that describe the columns, of two kinds; some codes are no more than their digits."""
    path = f"{sinks.scratch(t.spark)}/vendor"
    even = F.year("trade_date") % 2 == 0
    lines = t.bars.select(F.year("trade_date").alias("year"), F.month("trade_date").alias("month"), F.lit(3).alias("k"), F.concat_ws(",", F.col("stock_code").cast("int").cast("string"), F.col("trade_date").cast("string"), F.col("high").cast("string"), F.when(even, F.col("low").cast("string"))).alias("line"))
    tops = t.bars.select(F.year("trade_date").alias("year"), F.month("trade_date").alias("month"), even.alias("even")).distinct()
    head = lambda k, names: tops.select("year", "month", F.lit(k).alias("k"), F.when(F.col("even"), F.lit(names)).otherwise(F.lit(names.rpartition(",")[0])).alias("line"))
    files = lines.union(head(0, "Stkcd,Trddt,hi,lo")).union(head(1, "code,date,highest,lowest")).union(head(2, "none,none,yuan,yuan"))
    files.repartition("year", "month").sortWithinPartitions("year", "month", "k").select("year", "month", "line").write.partitionBy("year", "month").text(path)
    return ingest.vendor_rows(ingest.read_vendor(t.spark, path)).select("stock_code", "trade_date", "hi", "lo")


@register("l11_dated_files", "select trade_date, cast(trade_sec as int) as trade_sec, stock_code, open, volume from {ticks}", "open")
def l11_files(t: Tables) -> DataFrame:
    """Level-1 files in folders whose names hold their dates, and nothing inside does."""
    root = f"{sinks.scratch(t.spark)}/level1"
    raw = t.level1.select("trade_date", F.col("time_int").alias("time"), F.col("raw_code").alias("stock_code"), *(F.col("px").alias(c) for c in ("open", "high", "low", "close")), "volume", F.col("px").alias("amount"))
    dated = raw.withColumn("day", F.date_format("trade_date", "yyyyMMdd")).drop("trade_date")
    dated.repartition("day").write.partitionBy("day").csv(root, header=True)
    ddl = "time int, stock_code string, open double, high double, low double, close double, volume long, amount double"
    landed = t.spark.read.schema(ddl).option("header", "true").option("recursiveFileLookup", "true").csv(root)
    return ingest.level1_rows(landed).select("trade_date", "trade_sec", "stock_code", "open", "volume")


def timed(t: Tables) -> DataFrame:
    return t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", F.lpad(F.col("user_id").cast("string"), 6, "0").alias("stock_code"), (10 + F.col("value") / 100).alias("px"), (1 + F.col("event_id") % 50).alias("volume"))


_tsec = "cast(epoch(time_bucket(interval '15 minutes', ts)) as bigint)"
register("t2_minute_bars", f"select stock_code, start_sec, arg_min(px, (ts, event_id)) as open, max(px) as high, min(px) as low, arg_max(px, (ts, event_id)) as close, cast(sum(volume) as bigint) as volume, sum(px * volume) / sum(volume) as vwap from (select ts, event_id, lpad(cast(user_id as varchar), 6, '0') as stock_code, 10 + value / 100 as px, 1 + event_id % 50 as volume, {_tsec} as start_sec from {{events}}) x group by 1, 2", "open high low close vwap")(
    lambda t: feeds.minute_bars(timed(t), 15).withColumn("start_sec", F.unix_timestamp("start")).drop("start")
)


def timed_news(t: Tables) -> DataFrame:
    scored = F.least("value", F.lit(100.0)) / 50 - 1
    return t.events.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("news_id"), scored.alias("sentiment_score"), F.array(F.lpad((F.col("event_id") % 10).cast("string"), 6, "0")).alias("related_stocks"))


register("t3_sliding_sentiment", "select stock_code, start_sec, avg(score) as mean, count(*) as n from (select lpad(cast(event_id % 10 as varchar), 6, '0') as stock_code, least(value, 100) / 50 - 1 as score, unnest([cast(floor(epoch(ts) / 3600) as bigint) * 3600, cast(floor(epoch(ts) / 3600) as bigint) * 3600 - 3600]) as start_sec from {events}) x group by 1, 2", "mean")(
    lambda t: feeds.sliding_sentiment(timed_news(t)).withColumn("start_sec", F.unix_timestamp("start")).drop("start")
)
register("t4_news_bursts", "select stock_code, cast(floor(epoch(min(ts))) as bigint) as start_sec, count(*) as n from (select *, sum(fresh) over (partition by stock_code order by ts rows unbounded preceding) as burst from (select lpad(cast(event_id % 10 as varchar), 6, '0') as stock_code, ts, case when ts - lag(ts) over (partition by event_id % 10 order by ts) < interval '30 minutes' then 0 else 1 end as fresh from {events}) a) b group by stock_code, burst")(
    lambda t: feeds.news_bursts(timed_news(t)).select("stock_code", F.unix_timestamp("start").alias("start_sec"), "n")
)
register("t5_first_only", "select distinct concat('n', cast(event_id as varchar)) as news_id from {events}")(lambda t: feeds.first_only(timed_news(t).union(timed_news(t))).select("news_id"))

# --- flagship and the four benchmark queries ---------------------------------------------------------------------


def ranked_momentum(t: Tables, start: dt.date = dt.date(1995, 1, 1), end: dt.date = dt.date(2001, 12, 31), top: int = 20) -> DataFrame:
    rows = between(t.latest_bars(), start, end).withColumn("close", exprs.adjusted("close", "adj_factor", "forward"))
    last = calc.momentum(rows, (5,)).groupBy("stock_code").agg(F.max_by(F.struct("trade_date", "close", "momentum_5"), "trade_date").alias("r"))
    return last.select("stock_code", "r.*").orderBy(F.desc_nulls_last("momentum_5"), "stock_code").limit(top)


register("flagship_momentum", f"select stock_code, trade_date, close, momentum_5 from (select *, c / nullif(lag(c, 5) over ({_w}), 0) - 1 as momentum_5, row_number() over (partition by stock_code order by trade_date desc) as k from (select * exclude (close), close * adj_factor as close, close * adj_factor as c from {BARS_NOW} x) y) z where k = 1 order by momentum_5 desc nulls last, stock_code limit 20", "close momentum_5", 4)(ranked_momentum)
register("bench_stock_history", f"select trade_date, stock_code, close, volume from {{bars}} where stock_code = '000001'", "close", 7)(lambda t: t.bars.filter("stock_code = '000001'").select("trade_date", "stock_code", "close", "volume"))
register("bench_cross_section", f"select stock_code, close, volume from {{bars}} where trade_date = date '{DAY}'", "close", 7)(lambda t: between(t.bars, DAY, DAY).select("stock_code", "close", "volume"))
register("bench_price_scan", f"select trade_date, stock_code, close from {{bars}} where {IN_RANGE}", "close", 7)(lambda t: between(t.bars, START, END).select("trade_date", "stock_code", "close"))
register("bench_stock_aggregation", "select stock_code, avg(close) as mean, stddev_samp(close) as std, max(close) as most, min(close) as least from {bars} group by stock_code", "mean std most least", 7)(
    lambda t: t.bars.groupBy("stock_code").agg(F.avg("close").alias("mean"), F.stddev_samp("close").alias("std"), F.max("close").alias("most"), F.min("close").alias("least"))
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_momentum"](spark, sf_dir)
