"""Steps whose cost must follow the input: seen in plans and in how tables are laid out."""

import datetime as dt
import inspect

from pyspark.sql import functions as F

from quantloom.operators import calc, matrix
from quantloom.sources import ingest, sinks
from tests.test_scale import plan_of

D1 = dt.date(2020, 1, 1)


def bars(spark):
    rows = [(D1 + dt.timedelta(d), f"{k:06d}", 10.0 + d * k if d % 3 else None, 100 + d) for d in range(0, 900, 7) for k in range(3)]
    return spark.createDataFrame(rows, "trade_date date, stock_code string, close double, volume long")


def test_price_trend_is_one_scan(spark):
    """One summary of the stretches: windows over rows are made twice, not once more for each quantity carried."""
    assert plan_of(calc.volume_price_trend(bars(spark))).count("\n") < 40


def test_calendar_days_are_made_after_the_shuffle(spark):
    """Only a row a stock and stretch is dealt: nothing shuffles the days."""
    lines = plan_of(calc.filled_calendar(bars(spark))).splitlines()
    days = next(k for k, x in enumerate(lines) if "Generate explode(sequence(greatest" in x)
    assert any("Exchange" in x for x in lines[days:])
    assert calc.filled_calendar(bars(spark)).count() == 3 * (7 * 128 + 1)


def test_blocks_look_nothing_up_by_slot(spark):
    df = bars(spark)
    blocks = matrix.blocked(df, ["close"], matrix.places(df))
    assert "map_from_entries" not in blocks._jdf.queryExecution().optimizedPlan().toString()


def test_names_of_files_are_read_once(spark, tmp_path):
    for name in ("pe.x", "pb"):
        bars(spark).write.option("header", "true").csv(str(tmp_path / "a b" / f"{name}.csv"))
    got = ingest.read_fields(spark, str(tmp_path), "csv", "trade_date date, stock_code string, close double, volume long")
    assert "BroadcastHashJoin" in plan_of(got)
    assert {tuple(r) for r in got.groupBy("category", "field").agg(F.count(F.lit(1))).collect()} == {("a%20b", "pe.x", 387), ("a%20b", "pb", 387)}


def test_ranges_of_rewritten_tables_are_small():
    assert inspect.signature(sinks.recompressed).parameters["file_bytes"].default <= 64 << 20
