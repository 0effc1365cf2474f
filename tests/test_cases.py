"""Literal cases with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantloom.functions import exprs
from quantloom.functions.predicates import QueryFilter, between, members
from quantloom.operators import calc, factors, fusion, macro, news, pit, prices
from quantloom.sources import ingest, sinks
from quantloom.streaming import feeds

D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)


def stamp(day):
    return dt.datetime(2024, 1, day)


@pytest.fixture
def versions(spark):
    rows = [(D1, "000001", stamp(3), 10.0), (D1, "000001", stamp(5), 10.2), (D2, "000001", stamp(3), 10.0), (D2, "000001", stamp(5), 10.2)]
    return spark.createDataFrame(rows, "trade_date date, stock_code string, loaded_at timestamp, close double")


@pytest.mark.parametrize(("as_of", "close"), [("2024-01-04", 10.0), ("2024-01-06", 10.2), (None, 10.2)])
def test_as_of(versions, as_of, close):
    assert [r["close"] for r in pit.latest(versions, as_of=as_of).collect()] == [close, close]


def test_load_on_the_as_of_day_is_not_visible(versions):
    assert pit.latest(versions, as_of="2024-01-03").count() == 2  # loaded at midnight
    assert pit.latest(versions, as_of="2024-01-02").count() == 0


def test_shell_versions_are_skipped(versions, spark):
    shell = spark.createDataFrame([(D1, "000001", stamp(9), None)], versions.schema)
    both = versions.union(shell)
    assert pit.latest(both).filter("close is null").count() == 1
    assert pit.latest(both, non_null=("close",)).filter("close = 10.2").count() == 2


def test_ties_stay(versions):
    assert pit.latest(versions.union(versions)).count() == 4


def test_compaction_keeps_the_newest_old_version(spark):
    rows = [("000001", stamp(1), 10.0), ("000001", stamp(2), 10.1), ("000001", stamp(4), 10.2), ("000002", stamp(1), 20.0), ("000002", stamp(2), 20.1)]
    df = spark.createDataFrame(rows, "stock_code string, loaded_at timestamp, close double").withColumn("trade_date", F.lit(D1))
    kept = pit.compacted(df, "2024-01-03")
    assert sorted(r["close"] for r in kept.collect()) == [10.1, 10.2, 20.1]
    assert pit.compacted(kept, "2024-01-03").count() == 3


def test_codes(spark):
    cases = [("1", "000001"), ("000001.SZ", "000001"), (" 600000.SH ", "600000"), ("1234567", "1234567"), (None, "")]
    df = spark.createDataFrame(cases, "raw string, code string")
    assert df.filter(exprs.normalize_code("raw") != F.col("code")).count() == 0
    markets = spark.createDataFrame([("600000", "SH"), ("830000", "BJ"), ("900000", "BJ"), ("000001", "SZ"), ("12", ""), (None, "")], "c string, m string")
    assert markets.filter(exprs.market_of("c") != F.col("m")).count() == 0
    index = spark.createDataFrame([("000001.sh", True), ("1", False), (None, False)], "c string, i boolean")
    assert index.filter(exprs.is_index_code("c") != F.col("i")).count() == 0


def test_unknown_choices_raise(spark):
    with pytest.raises(ValueError):
        exprs.bucket("d", "Y")
    with pytest.raises(ValueError):
        exprs.adjusted("p", "f", "sideways")
    with pytest.raises(ValueError):
        ingest.route(spark.createDataFrame([(1,)], "x int"))


def test_filters(spark):
    df = spark.createDataFrame([(D1, "a"), (D2, "b")], "trade_date date, stock_code string")
    assert between(df).count() == 2 and between(df, D2).count() == 1 and members(df, ()).count() == 2
    assert members(df, [str(i) for i in range(2000)] + ["a"]).count() == 1
    assert QueryFilter(D1, D1, ("a",), ("stock_code",)).apply(df, ("trade_date",)).columns == ["stock_code"]


def test_column_upsert_keeps_what_it_does_not_know(spark):
    wide = spark.createDataFrame([(D1, "a", 1.0, 2.0), (D1, "b", 3.0, 4.0)], "trade_date date, stock_code string, pe double, pb double")
    new = spark.createDataFrame([(D1, "a", 9.0), (D1, "b", None), (D2, "c", 5.0)], "trade_date date, stock_code string, factor_value double")
    got = {(r["stock_code"]): (r["pe"], r["pb"]) for r in sinks.with_column_upserted(wide, new, "pe").collect()}
    assert got == {"a": (9.0, 2.0), "b": (3.0, 4.0), "c": (5.0, None)}


def test_pivot_and_back(spark):
    rows = [(D1, "a", "pe", stamp(2), 10.0), (D1, "a", "pe", stamp(3), 11.0), (D1, "b", "pb", stamp(2), 1.0)]
    long = spark.createDataFrame(rows, "trade_date date, stock_code string, factor_name string, loaded_at timestamp, factor_value double")
    wide = sinks.pivoted(long, ["pe", "pb"])
    assert {(r["stock_code"], r["pe"], r["pb"]) for r in wide.collect()} == {("a", 11.0, None), ("b", None, 1.0)}
    assert sinks.unpivoted(wide).count() == 2 and sinks.unpivoted(wide, skip_nulls=False).count() == 4
    new_wide, history = sinks.migrated(long, ["pe", "pb"], "2024-01-09")
    assert (new_wide.count(), history.count()) == (2, 3)


def test_write_policies(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 3)], "k string, v int, n int")
    assert {tuple(r) for r in sinks.replaced_by_key(old, new, ["k"], "n").collect()} == {("a", 1), ("b", 4), ("c", 5)}
    assert {r["k"] for r in sinks.ignored_if_exists(old, new.drop("n"), ["k"]).collect()} == {"a", "b", "c"}


def test_dates_are_written_once(spark, tmp_path):
    rows = [(D1, "a", 1.0), (D2, "a", 2.0)]
    df = spark.createDataFrame(rows, "trade_date date, stock_code string, px double")
    path = str(tmp_path / "ticks")
    assert sinks.append_new_dates(df, path, None).count() == 2
    have = spark.read.parquet(path)
    assert df.join(have.select("trade_date").distinct(), "trade_date", "left_anti").count() == 0
    plan = have.filter(F.col("trade_date") == F.lit(D1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan


def test_recompression_checks_the_count(spark, tmp_path):
    df = spark.range(100).selectExpr("id as stock_code")
    df.write.parquet(str(tmp_path / "a"))
    assert sinks.recompressed(spark, str(tmp_path / "a"), str(tmp_path / "b"), ["stock_code"])[1] == 100


def test_matrix_columns_that_collide_fail(spark):
    with pytest.raises(ValueError):
        ingest.unpivot_matrix(spark.createDataFrame([(D1, 1.0, 2.0)], "trade_date date, `000001.SZ` double, `000001.SH` double"))


def test_read_directory_by_field(spark, tmp_path):
    for f in ("open", "close"):
        (tmp_path / "prices").mkdir(exist_ok=True)
        (tmp_path / "prices" / f"{f}.csv").write_text("trade_date,000001\n2024-01-01,1.5\n")
    df = ingest.read_fields(spark, str(tmp_path), "csv")
    assert {(r["field"], r["category"]) for r in df.collect()} == {("open", "prices"), ("close", "prices")}


def test_ingest_logs_outcomes(spark):
    stored = {}
    good = spark.createDataFrame([("2024-01-01", "PMI", 50.5)], "date string, indicator string, val double")
    log = ingest.ingest({"good": good, "bad": spark.range(1)}, lambda t, df: stored.update({t: df.count()}), "2024-01-02")
    assert stored == {"macro_data": 1}
    assert {(r["source"], r["n"]) for r in log.collect()} == {("good", 1), ("bad", -1)}


def test_world_bank_rows(spark):
    text = '[{"page":1},[{"indicator":{"id":"SP.POP.TOTL","value":"Population"},"date":"2020","value":5.0},{"indicator":{"id":"X","value":"x"},"date":"2021","value":null}]]'
    got = ingest.world_rows(spark.createDataFrame([(text,)], "json string")).collect()
    assert [(r["indicator_id"], str(r["trade_date"]), r["value"], r["value_type"]) for r in got] == [("POPULATION", "2020-01-01", 5.0, "raw")]


def test_policy_rows_need_a_class_by_default(spark):
    html = '<ul><li class="x">short</li><li class="x">abc</li><a class="t" href="/p">Policy one</a><a href="/q">No class</a></ul>'
    got = ingest.policy_rows(spark.createDataFrame([(1, html), (2, ""), (3, None)], "page_id int, html string"), D1).collect()
    assert [(r["value_text"], r["url"]) for r in got] == [("short", ""), ("Policy one", "/p")]


def test_regimes(spark):
    rows = [(D1, "PMI", 51.0), (D1, "CPI_yoy", 2.5), (D2, "PMI", 49.0)]
    df = spark.createDataFrame(rows, "trade_date date, indicator_id string, value double").withColumn("value_type", F.lit("raw"))
    got = {r["trade_date"]: r["regime"] for r in macro.macro_regime(df).collect()}
    assert got == {D1: macro.REGIMES["hot"], D2: macro.REGIMES["recession"]}


def test_news_counts(spark):
    rows = [("1", D1, 0.8, "positive", ["000001"]), ("2", D1, -0.5, "negative", ["000001"]), ("3", D2, 0.1, "neutral", ["600000"])]
    df = spark.createDataFrame(rows, "news_id string, publish_date date, sentiment_score double, sentiment_label string, related_stocks array<string>")
    day = news.aggregated(df).filter(F.col("bucket") == F.lit(D1)).first()
    assert day["n"] == 2 and abs(day["mean"] - 0.15) < 1e-12
    top = news.sentiment_stocks(df, "positive", D1).first()
    assert (top["stock_code"], top["mean"], top["n"]) == ("000001", 0.8, 1)
    assert news.sentiment_stocks(df, "positive").count() == 0  # the last day of all news has none
    assert news.sentiment_stocks(df, "neutral").first()["stock_code"] == "600000"


def test_quantile_and_ranks(spark):
    rows = [(D1, c, "PE", stamp(2), v) for c, v in (("a", 15.5), ("b", 8.0), ("c", 25.0))]
    df = spark.createDataFrame(rows, "trade_date date, stock_code string, factor_name string, loaded_at timestamp, factor_value double")
    assert {r["stock_code"] for r in factors.quantile_stocks(df, "PE", D1, 0.5).collect()} == {"a", "c"}
    assert factors.screen(df, D1, ["factor_value < 20"]).count() == 2
    assert factors.rank_by_factors(df, D1, {"PE": -1}).first()["stock_code"] == "b"
    assert factors.factor_stats("none", df).first()["n"] == 0


def test_windows_warm_up(spark):
    rows = [(D1 + dt.timedelta(i), "a", 10.0 + i) for i in range(30)]
    df = spark.createDataFrame(rows, "trade_date date, stock_code string, close double").withColumns({c: F.col("close") for c in ("high", "low")}).withColumn("volume", F.lit(1))
    out = calc.all_factors(df).orderBy("trade_date").collect()
    assert [r["momentum_5"] is None for r in out[:6]] == [True] * 5 + [False]
    assert out[18]["bollinger_position"] is None and out[19]["bollinger_position"] is not None
    assert out[19]["volatility"] is None and out[20]["volatility"] is not None


def test_panel_slots(spark):
    df = spark.createDataFrame([(D1, "a", 1.0), (D2, "b", 2.0)], "trade_date date, stock_code string, close double")
    assert [r["close"] for r in prices.panel(df, ["close"], ["b", "a", "z"]).collect()] == [[None, 1.0, None], [2.0, None, None]]


def test_missing_scores_are_half(spark):
    stocks = spark.createDataFrame([("000001",)], "stock_code string")
    pe = spark.createDataFrame([], "stock_code string, factor_value double")
    feed = spark.createDataFrame([], "sentiment_score double, related_stocks array<string>")
    series = spark.createDataFrame([], "trade_date date, indicator_id string, value_type string, value double")
    data = spark.createDataFrame([], "trade_date date, data_id string, data_type string, entity_id string, value double")
    bars = spark.createDataFrame([], "trade_date date, stock_code string, close double")
    row = fusion.combined_score(stocks, D1, pe, feed, series, data, bars).first()
    assert row["total_score"] == pytest.approx(0.5)


def test_one_shuffle_for_the_latest_version(versions):
    plan = pit.latest(versions)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in plan


def events(spark, path):
    start = dt.datetime(2024, 1, 1, 9)
    rows = [(start + dt.timedelta(minutes=7 * i), i, f"00000{i % 3}", 10.0 + i % 5, 1 + i % 4) for i in range(40)]
    df = spark.createDataFrame(rows, "ts timestamp, event_id long, stock_code string, px double, volume long")
    df.write.parquet(path)
    return df


def drained(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append" if name == "first" else "complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    return stream.sparkSession.table(name)


@pytest.mark.parametrize("kind", ["bars", "sentiment", "first"])
def test_stream_equals_batch(spark, tmp_path, kind):
    path = str(tmp_path / "events")
    df = events(spark, path)
    make = {
        "bars": lambda x: feeds.minute_bars(x, 15),
        "sentiment": lambda x: feeds.sliding_sentiment(x.select("ts", F.col("px").alias("sentiment_score"), F.array("stock_code").alias("related_stocks"))),
        "first": lambda x: feeds.first_only(x.withColumn("news_id", F.col("event_id") % 10), late="1 day").select("news_id"),
    }[kind]
    got = drained(make(spark.readStream.schema(df.schema).parquet(path)), kind)
    assert sorted(map(str, got.collect())) == sorted(map(str, make(df).collect()))


def test_bursts(spark):
    rows = [(dt.datetime(2024, 1, 1, 9, m), ["a"]) for m in (0, 10, 50)]
    got = feeds.news_bursts(spark.createDataFrame(rows, "ts timestamp, related_stocks array<string>"), "30 minutes").collect()
    assert sorted(r["n"] for r in got) == [1, 2]


def test_stream_lands_by_date(spark, tmp_path):
    df = events(spark, str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        feeds.land_by_date(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == df.count()


def closes(spark, values, code="000001"):
    rows = [(D1 + dt.timedelta(k), code, x) for k, x in enumerate(values)]
    return spark.createDataFrame(rows, "trade_date date, stock_code string, close double")


def test_relative_strength_from_the_first_row(spark):
    values = [10.0, 11.0, 10.5, 10.5, 12.0] + [12.0 + (k % 3) for k in range(15)]
    moves = [0.0] + [b - a for a, b in zip(values, values[1:])]
    want = []
    for k in range(len(values)):
        seen = moves[max(0, k - 13) : k + 1]
        up, down = sum(max(x, 0) for x in seen) / len(seen), sum(max(-x, 0) for x in seen) / len(seen)
        want.append(100 - 100 / (1 + up / (down + 1e-10)))
    got = [r["rsi"] for r in calc.relative_strength(closes(spark, values)).orderBy("trade_date").collect()]
    assert got[0] == 0.0 and all(abs(a - b) < 1e-6 for a, b in zip(got, want, strict=True))


def test_macd_by_weights(spark):
    values = [10.0, 11.0, 10.5, 10.7, 12.0, 11.0, 9.5]

    def mean(x, span):
        keep = 1 - 2 / (span + 1)
        return [sum(x[i] * keep ** (k - i) for i in range(k + 1)) / sum(keep ** (k - i) for i in range(k + 1)) for k in range(len(x))]

    line = [a - b for a, b in zip(mean(values, 12), mean(values, 26), strict=True)]
    rows = calc.macd(closes(spark, values).unionByName(closes(spark, values[::-1], "000002"))).filter("stock_code = '000001'").orderBy("trade_date").collect()
    assert all(abs(r["macd"] - a) < 1e-9 and abs(r["macd_signal"] - b) < 1e-9 for r, a, b in zip(rows, line, mean(line, 9), strict=True))


def test_panel_with_versions_that_tie(spark):
    rows = [(D1, "000001", 1.0), (D1, "000001", 2.0), (D2, "000002", 3.0)]
    df = spark.createDataFrame(rows, "trade_date date, stock_code string, close double")
    assert [tuple(r) for r in prices.panel(df, ["close"], ["000001", "000002"]).collect()] == [(D1, [2.0, None]), (D2, [None, 3.0])]


def test_write_policies_with_repeated_keys(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    new = spark.createDataFrame([(2, 5.0, 1), (2, 4.0, 2), (3, 6.0, 1)], "k int, v double, seq int")
    assert sorted(map(tuple, sinks.replaced_by_key(old, new, ["k"], "seq").collect())) == [(1, 1.0), (2, 4.0), (3, 6.0)]
    assert sorted(map(tuple, sinks.replaced_by_key(old, new.drop("seq"), ["k"]).collect())) == [(1, 1.0), (2, 5.0), (3, 6.0)]
    assert sorted(map(tuple, sinks.ignored_if_exists(old, new.drop("seq").filter("k > 2 or v < 5"), ["k"]).collect())) == [(1, 1.0), (2, 2.0), (3, 6.0)]
    wide = spark.createDataFrame([(D1, "000001", 1.0)], "trade_date date, stock_code string, PE double")
    fresh = spark.createDataFrame([(D1, "000001", 7.0), (D1, "000001", 8.0), (D2, "000001", None)], "trade_date date, stock_code string, factor_value double")
    assert [tuple(r) for r in sinks.with_column_upserted(wide, fresh, "PE").collect()] == [(D1, "000001", 8.0)]


def test_forward_returns_skip_stocks_without_the_date(spark):
    days = [D1 + dt.timedelta(k) for k in range(4)]
    rows = [(d, c, 10.0 + k + (3 if c == "b" else 0) * k) for k, d in enumerate(days) for c in "abc" if not (c == "c" and k in (1, 3))]
    price = spark.createDataFrame(rows, "trade_date date, stock_code string, close double")
    value = price.select("trade_date", "stock_code", F.col("close").alias("factor_value"))
    got = {r["trade_date"]: r["n"] for r in factors.ic_series(value, price, 2).collect()}
    assert got == {days[0]: 3, days[1]: 2}
    assert {r["trade_date"]: r["n"] for r in factors.ic_series(value, price, 1).collect()} == {days[0]: 2, days[1]: 2, days[2]: 2}
