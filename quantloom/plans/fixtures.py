"""Market tables that Spark derives from the given ones, in SQL that both engines run.

``{name}`` stands for a given table or another fixture.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def code(x: str) -> str:
    return f"lpad(cast({x} as varchar(10)), 6, '0')"


_LINES = f"""select cast(l_shipdate as date) as trade_date, {code('l_suppkey')} as stock_code, l_extendedprice / l_quantity as px,
 l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax from {{lineitem}}"""
_PLACE = "(l_orderkey, l_linenumber, l_partkey)"

SQL: dict[str, str] = {
    "lines": _LINES,
    "bars": f"""select trade_date, stock_code, min_by(px, {_PLACE}) as open, max(px) as high, min(px) as low,
 max_by(px, {_PLACE}) as close, cast(sum(l_quantity) as bigint) as volume, sum(l_extendedprice) as amount,
 1 - cast(0.5 as double) * avg(l_discount) as adj_factor, sum(l_quantity) / 1000 as turnover from {{lines}} group by trade_date, stock_code""",
    "bars_versions": """select trade_date, stock_code, open, high, low, close, volume, amount, adj_factor, turnover, cast(trade_date as timestamp) + interval '1' day as loaded_at from {bars}
 union all select trade_date, stock_code, open, high, low, close * cast(1.01 as double), volume, amount, adj_factor, turnover, cast(trade_date as timestamp) + interval '10' day from {bars} where extract(day from trade_date) % 3 = 0
 union all select trade_date, stock_code, cast(null as double), cast(null as double), cast(null as double), cast(null as double), cast(null as bigint), cast(null as double), adj_factor * cast(1.1 as double), cast(null as double), cast(trade_date as timestamp) + interval '20' day from {bars} where extract(day from trade_date) % 5 = 0""",
    "field_versions": """select trade_date, stock_code, open, cast(null as double) as high, cast(null as double) as close, cast(trade_date as timestamp) + interval '1' hour as loaded_at from {bars}
 union all select trade_date, stock_code, cast(null as double), high, cast(null as double), cast(trade_date as timestamp) + interval '2' hour from {bars}
 union all select trade_date, stock_code, cast(null as double), cast(null as double), close, cast(trade_date as timestamp) + interval '3' hour from {bars}
 union all select trade_date, stock_code, cast(null as double), cast(null as double), close * cast(1.01 as double), cast(trade_date as timestamp) + interval '4' hour from {bars} where extract(day from trade_date) % 3 = 0""",
    "factor_values": """select trade_date, stock_code, 10 + 100 * avg(l_discount) as pe, 1 + 10 * avg(l_tax) as pb, avg(l_quantity) as roe from {lines} group by trade_date, stock_code""",
    "factor_long": """select trade_date, stock_code, 'PE' as factor_name, pe as factor_value, cast(trade_date as timestamp) + interval '1' day as loaded_at from {factor_values}
 union all select trade_date, stock_code, 'PB', pb, cast(trade_date as timestamp) + interval '1' day from {factor_values}
 union all select trade_date, stock_code, 'ROE', roe, cast(trade_date as timestamp) + interval '1' day from {factor_values} where roe > 5
 union all select trade_date, stock_code, 'PE', pe * cast(1.1 as double), cast(trade_date as timestamp) + interval '10' day from {factor_values} where extract(day from trade_date) % 4 = 0""",
    "stock_info": f"""select {code('s_suppkey')} as stock_code, s_name as stock_name, n_name as industry, n_nationkey as industry_code, r_name as market
 from {{supplier}} join {{nation}} on s_nationkey = n_nationkey join {{region}} on n_regionkey = r_regionkey""",
    "macro_months": """select cast(date_trunc('month', o_orderdate) as date) as trade_date, avg(case when o_orderstatus = 'F' then cast(1 as double) else cast(0 as double) end) as f, avg(o_totalprice) as p, count(*) as n from {orders} group by 1""",
    "macro_data": """select trade_date, 'PMI' as indicator_id, 'PMI' as indicator_name, 17 + 100 * f as value, 'raw' as value_type, 'src_a' as source_id from {macro_months}
 union all select trade_date, 'CPI_yoy', 'CPI_yoy', p / 125000, 'raw', 'src_a' from {macro_months}
 union all select trade_date, 'M2_yoy', 'M2_yoy', cast(n as double) / 10, 'raw', 'src_b' from {macro_months}
 union all select trade_date, 'PMI', 'PMI', (17 + 100 * f) / 100, 'change', 'src_a' from {macro_months}""",
    "macro_indicators": """select indicator_id, case indicator_id when 'PMI' then 'activity' when 'CPI_yoy' then 'price' else 'money' end as category, 'monthly' as frequency from {macro_data} group by indicator_id""",
    "news_sentiment": f"""select concat('n', cast(event_id as varchar(20))) as news_id, event_id, date '1998-01-01' + cast(extract(day from ts) - 1 as int) as publish_date,
 cast(extract(hour from ts) * 3600 + extract(minute from ts) * 60 as int) as publish_sec, event_type as title, {code('user_id % 100')} as stock_a, {code('event_id % 10')} as stock_b,
 least(value, 100) / 50 - 1 as sentiment_score, case when value >= 60 then 'positive' when value < 20 then 'negative' else 'neutral' end as sentiment_label,
 event_id % 97 as read_count, event_id % 11 as comment_count from {{events}}""",
    "news_stocks": """select news_id, publish_date, sentiment_score, sentiment_label, stock_a as stock_code from {news_sentiment} union all select news_id, publish_date, sentiment_score, sentiment_label, stock_b from {news_sentiment}""",
    "level1": f"""select event_id, cast(ts as date) as trade_date, cast(extract(hour from ts) * 10000 + extract(minute from ts) * 100 + floor(extract(second from ts)) as int) as time_int, user_id as raw_code, 10 + value / 100 as px, cast(1 + event_id % 50 as bigint) as volume from {{events}}""",
    "ticks": f"""select event_id, trade_date, (time_int - time_int % 10000) / 10000 * 3600 + (time_int % 10000 - time_int % 100) / 100 * 60 + time_int % 100 as trade_sec, {code('raw_code')} as stock_code, px as open, px as high, px as low, px as close, volume, px * volume as amount from {{level1}}""",
    "alternative_data": """select concat(lower(c_mktsegment), '_', case when c_nationkey % 2 = 0 then '00' else '01' end, '_', cast(cast(o_orderdate as date) as varchar(10))) as data_id, cast(o_orderdate as date) as trade_date, 'chain' as data_type, lower(c_mktsegment) as data_subtype,
 'industry' as entity_type, case when c_nationkey % 2 = 0 then '00' else '01' end as entity_id, avg(o_totalprice) / 71 as value, 'src_c' as source_id
 from {orders} join {customer} on o_custkey = c_custkey group by 1, 2, 4, 6""",
    "report_sentiment": f"""select concat('r', cast(d.doc_id as varchar(20))) as report_id, date '1998-01-01' + cast(d.doc_id % 90 as int) as publish_date, d.source as title, d.lang as brokerage, {code('d.doc_id % 100')} as related_stock,
 cast(coalesce(l.quality, 0) - coalesce(l.toxic, 0) as double) as sentiment_score from {{documents}} d left join {{labels}} l on d.doc_id = l.doc_id""",
}


def needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a fixture as a DataFrame."""
    if name in GIVEN:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(SQL[name], **{x: frame(spark, sf_dir, x) for x in needs(SQL[name])})


def with_fixtures(sql: str) -> str:
    """SQL for the oracle: ``{name}`` references become common table expressions before the query."""
    done: dict[str, str] = {}

    def add(text: str) -> None:
        for x in needs(text):
            if x in SQL and x not in done:
                add(SQL[x])
                done[x] = SQL[x]

    add(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    ctes = ", ".join(f"{k} as ({plain(v)})" for k, v in done.items())
    return f"with {ctes} {plain(sql)}" if ctes else plain(sql)
