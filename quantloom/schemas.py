"""Field lists of the tables: the contract of what the loaders write and the queries read."""

from __future__ import annotations

from pyspark.sql import types as T

_OHLC = "open double, high double, low double, close double, volume bigint, amount double"

DDL = {
    "level1_snapshots": f"trade_date date, trade_sec int, stock_code string, {_OHLC}",
    "daily_prices": f"trade_date date, stock_code string, loaded_at timestamp, {_OHLC}, adj_factor double, turnover double",
    "stock_info": "stock_code string, stock_name string, list_date date, delist_date date, industry string, industry_code string, market string, update_time timestamp",
    "trade_calendar": "trade_date date, is_trading_day boolean, week_day int, is_month_end boolean, is_quarter_end boolean, is_year_end boolean",
    "factor_data": "trade_date date, stock_code string, factor_name string, loaded_at timestamp, factor_value double",
    "factor_history": "trade_date date, stock_code string, factor_name string, factor_value double, loaded_at timestamp",
    "factor_info": "factor_name string, factor_type string, description string, category string, update_time timestamp",
    "data_categories": "category_id string, category_name string, description string, priority int, update_time timestamp",
    "data_sources": "source_id string, source_name string, provider string, update_frequency string, contact_info string, is_active boolean, update_time timestamp",
    "data_dictionary": "field_id string, category_id string, field_name string, field_type string, description string, unit string, source_id string, update_time timestamp",
    "macro_data": "trade_date date, indicator_id string, value_type string, indicator_name string, value double, data_quality int, source_id string, update_time timestamp",
    "macro_indicators": "indicator_id string, indicator_name string, category string, frequency string, unit string, is_leading boolean, description string, update_time timestamp",
    "news_sentiment": "news_id string, publish_date date, publish_sec int, title string, content string, source_id string, related_stocks array<string>, related_industries array<string>, "
    "sentiment_score double, sentiment_label string, keyword_count int, read_count int, comment_count int, update_time timestamp",
    "report_sentiment": "report_id string, publish_date date, title string, analyst string, brokerage string, related_stock string, rating_change string, target_price double, current_price double, "
    "sentiment_score double, content_summary string, update_time timestamp",
    "alternative_data": "data_id string, trade_date date, data_type string, data_subtype string, entity_type string, entity_id string, entity_name string, value double, value_text string, "
    "value_array array<double>, data_quality int, source_id string, metadata string, update_time timestamp",
    "alternative_types": "data_type string, type_name string, description string, default_entity_type string, is_time_series boolean, update_time timestamp",
}

KEYS = {
    "level1_snapshots": ("trade_date", "trade_sec", "stock_code"),
    "daily_prices": ("trade_date", "stock_code", "loaded_at"),
    "stock_info": ("stock_code",),
    "trade_calendar": ("trade_date",),
    "factor_data": ("trade_date", "stock_code", "factor_name", "loaded_at"),
    "factor_info": ("factor_name",),
    "data_categories": ("category_id",),
    "data_sources": ("source_id",),
    "data_dictionary": ("field_id",),
    "macro_data": ("trade_date", "indicator_id", "value_type"),
    "macro_indicators": ("indicator_id",),
    "news_sentiment": ("news_id",),
    "report_sentiment": ("report_id",),
    "alternative_data": ("data_id",),
    "alternative_types": ("data_type",),
}


def schema(table: str) -> T.StructType:
    return T._parse_datatype_string(DDL[table])
