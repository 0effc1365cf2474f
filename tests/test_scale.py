"""Scans, selection and blocked matrices: against plain versions, and that no task or plan grows with the data."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import calc, factors, matrix, scans, selection
from quantloom.sources import ingest, sinks

D1 = dt.date(2020, 1, 1)
BAR = "trade_date date, stock_code string, close double, volume long"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def history(spark):
    """Two stocks over four years with gaps and missing prices, and one with a single row."""
    rng = np.random.default_rng(1)
    rows = []
    for code in ("000001", "000002"):
        price = 10 * np.exp(np.cumsum(rng.normal(size=1400) * 0.02))
        for k in range(1400):
            if rng.random() < 0.8 or k in (0, 1399):
                rows.append((D1 + dt.timedelta(k), code, None if rng.random() < 0.05 else float(price[k]), None if rng.random() < 0.05 else int(rng.integers(1, 1000))))
    rows.append((D1 + dt.timedelta(700), "000003", 5.0, 1))
    return spark.createDataFrame(rows, BAR).repartition(3).cache()


def by_stock(df, name):
    rows = df.orderBy("stock_code", "trade_date").toPandas()
    return {c: part[name].to_numpy(dtype=float) for c, part in rows.groupby("stock_code")}


def close_to(got, want):
    return got.keys() == want.keys() and all(np.allclose(got[c], want[c], rtol=1e-9, atol=1e-9, equal_nan=True) for c in want)


def test_macd_over_many_stretches(history):
    rows = history.orderBy("stock_code", "trade_date").toPandas()
    mean = lambda x, span: x.ewm(span=span, adjust=True).mean()
    want = {c: (mean(p["close"], 12) - mean(p["close"], 26)) for c, p in rows.groupby("stock_code")}
    got = calc.macd(history)
    assert close_to(by_stock(got, "macd"), {c: x.to_numpy() for c, x in want.items()})
    assert close_to(by_stock(got, "macd_signal"), {c: mean(x, 9).to_numpy() for c, x in want.items()})


def test_volume_price_trend_over_many_stretches(history):
    rows = history.orderBy("stock_code", "trade_date").toPandas()
    want = {}
    for c, p in rows.groupby("stock_code"):
        filled = p["close"].astype(float).ffill()
        want[c] = (p["volume"].astype(float).diff() * (filled / filled.shift() - 1)).fillna(0.0).cumsum().to_numpy()
    assert close_to(by_stock(calc.volume_price_trend(history), "vpt"), want)


def test_filled_calendar_over_many_stretches(history):
    rows = history.toPandas()
    days = pd.date_range(min(rows["trade_date"]), max(rows["trade_date"]))
    want = {}
    for c, p in rows.groupby("stock_code"):
        want[c] = p.assign(trade_date=pd.to_datetime(p["trade_date"])).set_index("trade_date")["close"].astype(float).reindex(days).ffill().to_numpy()
    assert close_to(by_stock(calc.filled_calendar(history), "close"), want)


def test_one_stock_is_many_tasks_without_python(spark, history):
    for out in (calc.macd(history), calc.volume_price_trend(history), calc.filled_calendar(history)):
        plan = plan_of(out)
        assert "Python" not in plan and "Pandas" not in plan and "hashpartitioning(stock_code" in plan and "_stretch" in plan
    rows = scans.stretched(history.filter("stock_code = '000001'").coalesce(1))
    assert rows.select(scans.STRETCH).distinct().count() >= 5


NUMBERS = {
    "normal": lambda rng: rng.normal(size=3000),
    "ties": lambda rng: rng.integers(0, 4, 3000).astype(float),
    "all magnitudes": lambda rng: np.exp(rng.uniform(-700, 700, 3000)) * rng.choice([-1, 1], 3000),
    "one far": lambda rng: np.append(rng.normal(size=2999) * 1e-12 + 1, 1e300),
    "zeros and least": lambda rng: np.concatenate([np.zeros(1500), -np.zeros(100), np.full(1400, 5e-324)]),
    "infinite": lambda rng: np.concatenate([rng.normal(size=1000), np.full(900, np.inf), np.full(1100, -np.inf)]),
}


@pytest.mark.parametrize("kind", NUMBERS)
def test_exact_quantiles(spark, monkeypatch, kind):
    monkeypatch.setattr(selection, "FEW", 20)
    monkeypatch.setattr(selection, "BINS", 16)
    values = NUMBERS[kind](np.random.default_rng(4))
    df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "v double")
    for share in (0.0, 0.31, 0.5, 1.0):
        low, high = (np.sort(values)[f(share * (len(values) - 1))] for f in (math.floor, math.ceil))
        at = share * (len(values) - 1)
        want = low if low == high else low + (high - low) * (at - math.floor(at))
        assert selection.quantiles(df, "v", share).first()["quantile"] == pytest.approx(want, rel=1e-12)


def test_quantiles_of_groups(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 5)
    monkeypatch.setattr(selection, "BINS", 8)
    rng = np.random.default_rng(6)
    rows = [(g, float(x)) for g, n in (("a", 1), ("b", 2), ("c", 777), (None, 50)) for x in rng.normal(size=n)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in factors.value_stats(df, "v", "g").collect()}
    assert got["none"]["median"] is None and got["none"]["n"] == 1 and len(got) == 5
    for g in ("a", "b", "c", None):
        assert got[g]["median"] == pytest.approx(np.median([x for k, x in rows if k == g]))
    assert factors.value_stats(df.limit(0), "v").first()["median"] is None
    assert factors.value_stats(df.limit(0), "v", "g").count() == 0


def test_a_round_holds_bins_not_values(spark):
    counted = []
    for n in (20_000, 80_000):
        bounds = spark.createDataFrame([(n // 2, 0.0, 1.0, 0, n)], "_rank long, _low double, _high double, _below long, _left long")
        rows = spark.range(n).select((F.col("id") / n).alias("_value"))
        seen = selection.with_bounds(rows, bounds, (), 1).select(selection.bin_of(F.col("_value"), F.col("_low"), F.col("_high")).alias("b"))
        counted.append(seen.distinct().count())
        assert "percentile" not in plan_of(seen)
    assert max(counted) <= selection.BINS


def test_blocked_matrix_and_back(spark):
    rows = [(D1 + dt.timedelta(k % 3), f"{k:06d}", float(k), k) for k in range(10)] + [(D1, "000000", -5.0, 3), (D1, None, 1.0, 1), (D1, "000004", None, None)]
    df = spark.createDataFrame(rows, BAR)
    places = matrix.places(df)
    wide = matrix.blocked(df, ["close", "volume"], places, 4)
    assert {(len(r["close"]), len(r["volume"])) for r in wide.collect()} == {(4, 4)}
    want = sorted((d, c, max(0.0, v) if c == "000000" else v, n if c != "000000" else 3) for d, c, v, n in rows[:10])
    assert sorted(tuple(r) for r in matrix.unblocked(wide, ["close", "volume"], places, 4).collect()) == want


def test_matrix_plans_do_not_grow_with_the_stocks(spark, tmp_path):
    sizes = []
    for n in (5, 500):
        df = spark.range(n).select(F.lit(D1).alias("trade_date"), F.lpad(F.col("id").cast("string"), 6, "0").alias("stock_code"), F.col("id").cast("double").alias("close"))
        places = matrix.places(df)
        back = matrix.unblocked(matrix.blocked(df, ["close"], places), ["close"], places)
        path = str(tmp_path / str(n))
        matrix.matrix_lines(df, "close", places).repartition("year").sortWithinPartitions("year", F.desc("head")).select("year", "line").write.partitionBy("year").text(path)
        landed = ingest.read_matrix(spark, path)
        assert back.count() == landed.count() == n
        sizes.append((plan_of(back).count("\n"), plan_of(landed).count("\n")))
    assert sizes[0] == sizes[1]


def test_landed_matrices_have_their_own_headers(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.csv").write_text("trade_date,000001.SZ,2\n2024-01-01,1.5,\n2024-01-02,x,2.5\n\n")
    (tmp_path / "m" / "b.csv").write_text("trade_date,2,3\n2024-01-03,7,8,9\nnot a date,1,1\n")
    got = sorted((str(r["trade_date"]), r["stock_code"], r["val"]) for r in ingest.read_matrix(spark, str(tmp_path / "m")).collect())
    assert got == [("2024-01-01", "000001", 1.5), ("2024-01-02", "000002", 2.5), ("2024-01-03", "000002", 7.0), ("2024-01-03", "000003", 8.0)]
    (tmp_path / "m" / "c.csv").write_text("trade_date,1,000001.SH\n")
    with pytest.raises(ValueError):
        ingest.read_matrix(spark, str(tmp_path / "m"))


def test_scores_read_only_the_days_they_need(spark, tmp_path):
    """The price score needs twenty days before its date: that filter reaches the scan of a table in folders by date."""
    from quantloom.operators import fusion, pit

    rows = [(D1 + dt.timedelta(d), f"{k:06d}", 10.0 + d, dt.datetime(2021, 1, 1)) for d in range(60) for k in range(3)]
    df = spark.createDataFrame(rows, "trade_date date, stock_code string, close double, loaded_at timestamp")
    df.repartition("trade_date").write.partitionBy("trade_date").parquet(str(tmp_path / "bars"))
    score = fusion.price_score(pit.latest(spark.read.parquet(str(tmp_path / "bars")), non_null=("close",)), D1 + dt.timedelta(50))
    filters = [x.split("]")[0] for x in plan_of(score).split("PartitionFilters: [")[1:]]
    assert filters and all("trade_date" in x and ">=" in x and "<=" in x for x in filters)
    assert score.count() == 3


def test_landed_lines_grow_with_their_length_alone(spark, tmp_path):
    """40,000 stocks, of which a date has few, others all: gaps at either end, and no look-up of each stock among all of a date's."""
    import time

    n = 40_000
    codes = spark.range(n).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("stock_code"), F.col("id").cast("double").alias("close"))
    days = [codes.withColumn("trade_date", F.lit(D1 + dt.timedelta(k))) for k in range(3)]
    df = days[0].union(days[1]).union(days[2].filter("close % 9973 = 17 or close = 39999"))
    path, begun = str(tmp_path / "m"), time.time()
    matrix.matrix_lines(df, "close", matrix.places(df)).repartition("year").sortWithinPartitions("year", F.desc("head")).select("year", "line").write.partitionBy("year").text(path)
    landed = ingest.read_matrix(spark, path).select("trade_date", "stock_code", F.col("val").alias("close"))
    same = df.select("trade_date", "stock_code", "close")
    assert landed.exceptAll(same).count() == same.exceptAll(landed).count() == 0
    assert time.time() - begun < 15
    with pytest.raises(Exception, match="two rows"):
        matrix.matrix_lines(df.union(days[0].limit(1).select(*df.columns)), "close", matrix.places(df)).collect()
