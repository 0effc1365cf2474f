"""Tables that stay in place: literal cases, what is rewritten and what is not, and what is read."""

import datetime as dt
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quantloom.operators import prices
from quantloom.plans import catalogue
from quantloom.sources import ingest, sinks, stored

D1, D2, D3 = dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 2, 5)
DATA = "/root/testdata/sf0.001"


def stamp(day, month=1):
    return dt.datetime(2024, month, day)


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def scan_metrics(df):
    """Metrics of the one file scan after the rows were collected."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    leaves = plan.collectLeaves()
    scan = next(x for x in (leaves.apply(i) for i in range(leaves.size())) if "Scan" in x.nodeName() or "QueryStage" in x.nodeName())
    metrics = scan.metrics()
    return lambda name: metrics.apply(name).value()


def test_compaction_of_a_stored_table(spark, tmp_path):
    rows = [("000001", stamp(1), 10.0), ("000001", stamp(2), 10.1), ("000001", stamp(4), 10.2), ("000002", stamp(1), 20.0), ("000002", stamp(2), 20.1)]
    df = spark.createDataFrame(rows, "stock_code string, loaded_at timestamp, close double").withColumn("trade_date", F.lit(D1))
    other = spark.createDataFrame([("000001", stamp(9, 2), 7.0)], "stock_code string, loaded_at timestamp, close double").withColumn("trade_date", F.lit(D3))
    path = str(tmp_path / "t")
    stored.with_month(df.unionByName(other)).repartition("month").write.partitionBy("month").parquet(path)
    before = files(path)
    report = stored.compact_table(spark, path, "2024-01-03")
    assert [tuple(r) for r in report.collect()] == [(D1, 3, 2)]
    assert sorted(r["close"] for r in spark.read.parquet(path).collect()) == [7.0, 10.1, 10.2, 20.1]
    same = {f: t for f, t in before.items() if "month=2024-02-01" in f}
    assert same and same.items() <= files(path).items()
    assert not {f for f in before if "month=2024-01-01" in f} & set(files(path))
    after = files(path)
    assert stored.compact_table(spark, path, "2024-01-03").count() == 0 and files(path) == after


def values(spark, rows):
    return spark.createDataFrame(rows, "trade_date date, stock_code string, factor_value double")


def test_factor_loads_keep_what_they_do_not_know(spark, tmp_path):
    root = str(tmp_path / "f")
    stored.store_factor(spark, root, values(spark, [(D1, "a", 1.0), (D2, "a", 2.0), (D3, "a", 3.0), (D3, "b", None)]), "pe", "2024-03-01")
    january = {f: t for f, t in files(f"{root}/wide").items() if "2024-01-01" in f}
    for _ in range(2):
        stored.store_factor(spark, root, values(spark, [(D3, "a", 9.0), (D3, "c", 4.0), (D3, "c", 5.0)]), "pb", "2024-03-02")
        assert january.items() <= files(f"{root}/wide").items()  # the column is new, and the other month is as it was
    stored.store_factor(spark, root, values(spark, [(D1, "a", 7.0), (D2, "a", None)]), "pe", "2024-03-03")
    wide = {(r["trade_date"], r["stock_code"]): (r["pe"], r["pb"]) for r in stored.stored_wide(spark, root).collect()}
    assert wide == {(D1, "a"): (7.0, None), (D2, "a"): (2.0, None), (D3, "a"): (3.0, 9.0), (D3, "c"): (None, 5.0)}
    history = sorted((r["factor_name"], r["trade_date"], r["stock_code"], r["factor_value"], r["loaded_at"].day) for r in stored.stored_history(spark, root).collect())
    assert history == [("pb", D3, "a", 9.0, 2), ("pb", D3, "c", 5.0, 2), ("pe", D1, "a", 1.0, 1), ("pe", D1, "a", 7.0, 3), ("pe", D2, "a", 2.0, 1), ("pe", D3, "a", 3.0, 1)]


def test_level1_reads_only_the_folders_it_needs(spark, tmp_path):
    rows = [(D1 + dt.timedelta(d), 34200 + 60 * k, f"{k % 3:06d}", k, 10.0 + k) for d in range(40) for k in range(5)]
    ticks = spark.createDataFrame(rows, "trade_date date, trade_sec int, stock_code string, event_id int, close double").withColumn("volume", F.lit(1)).withColumn("amount", F.col("close"))
    path = str(tmp_path / "ticks")
    sinks.append_new_dates(ticks, path, None)
    table = spark.read.parquet(path)
    fields = ("trade_date", "trade_sec", "stock_code", "close")
    day = prices.level1(table, ("000001",), D2, 34200, 34320, fields)
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(trade_date" in plan and "PushedFilters" in plan and "trade_sec" in plan.split("PushedFilters")[1]
    assert day.count() == 1
    one = prices.level1(table, (), D2, fields=fields).drop("trade_date").sortWithinPartitions("trade_sec").select("close")
    assert scan_metrics(table.filter(F.col("trade_date") == F.lit(D2)).select("close"))("numFiles") == 1 and one.count() == 5
    calendar = ingest.trade_calendar(ticks.select("trade_date"))
    ends = prices.level1_of(table, calendar.filter("is_month_end"), fields)
    assert "dynamicpruning" in ends._jdf.queryExecution().executedPlan().toString().lower()
    assert sorted({r["trade_date"] for r in ends.collect()}) == [dt.date(2024, 1, 31), dt.date(2024, 2, 9)]


def test_late_ticks_change_only_their_own_partials(spark, tmp_path):
    rows = [(D1, 34200 + k, "a", k, 10.0 + (k * 7) % 11) for k in range(200)]
    ticks = spark.createDataFrame(rows, "trade_date date, trade_sec int, stock_code string, event_id int, close double")
    ticks = ticks.withColumns({c: F.col("close") for c in ("open", "high", "low")} | {"volume": F.lit(2), "amount": F.col("close") * 2})
    root, late = str(tmp_path / "p"), F.col("event_id") % 9 == 0
    stored.store_partials(ticks.filter(~late), root, "day")
    first = files(root)
    for _ in range(2):
        stored.store_partials(ticks.filter(late), root, "late")
    assert first.items() <= files(root).items()
    bars = lambda minutes: sorted(map(str, stored.merged_bars(stored.stored_partials(spark, root), minutes).drop("n_ticks").collect()))
    for minutes in (None, 1, 2):
        assert bars(minutes) == sorted(map(str, prices.bars(ticks, minutes).collect()))


def test_a_failing_source_does_not_stop_the_others(spark, tmp_path):
    root = str(tmp_path / "run")
    good = spark.createDataFrame([("2024-01-01", "PMI", 50.5)], "date string, indicator string, val double")
    broken = good.withColumn("val", F.raise_error(F.lit("down")).cast("double"))
    done = ingest.stored_run({"good": good, "broken": broken, "odd": spark.range(1)}, root, "r1", "2024-01-02")
    assert {(r["source"], r["n"]) for r in done.collect()} == {("good", 1), ("broken", -1), ("odd", -1)}
    assert ingest.stored_rows(spark, root, "macro_data").first()["value"] == 50.5
    ingest.stored_run({"good": good.withColumn("val", F.lit(51.0)), "broken": good.withColumn("indicator", F.lit("CPI"))}, root, "r2", "2024-01-03", ["macro_data"])
    ingest.stored_run({"good": good.withColumn("val", F.lit(51.0))}, root, "r2b", "2024-01-04", ["news_sentiment"])  # nothing of that table
    assert sorted((r["indicator_id"], r["value"]) for r in ingest.stored_rows(spark, root, "macro_data").collect()) == [("CPI", 50.5), ("PMI", 51.0)]
    assert [r["run"] for r in ingest.ingest_log(spark, root, "good").collect()] == ["r2", "r1"]
    assert {r["source"] for r in ingest.ingest_log(spark, root, failed=True).collect()} == {"broken", "odd"}
    status = {r["source"]: (r["last_n"], r["n_runs"], r["n_failed"], r["n_stored"]) for r in ingest.ingest_status(spark, root).collect()}
    assert status == {"good": (1, 2, 0, 2), "broken": (1, 2, 1, 1), "odd": (-1, 1, 1, 0)}
    with pytest.raises(ValueError):
        ingest.stored_run({}, root, "r3", "2024-01-05")


def test_metadata_rows_are_those_of_each_file(spark, tmp_path):
    body = "".join(f"{k},2024-01-{1 + k % 28:02d},{k / 2}\n" for k in range(2000))
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.csv").write_text("﻿Stkcd,Trddt,Clsprc\ncode,date,close\nnone,none,yuan\n" + body)
    (tmp_path / "v" / "b.csv").write_text("Stkcd,Trddt,Clsprc\ncode,date,close\nnone,none,yuan\n7,2024-01-05,1.5\n")
    (tmp_path / "v" / "c.csv").write_text('Stkcd,Trddt,Opnprc\n"a, b",x,y\nz,z,z\n8,2024-01-05,2.5\n')
    for size in ("128m", "2k"):  # whole files, and many splits of one file
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = ingest.read_vendor(spark, str(tmp_path / "v"))
            assert got.count() == 2002 and got.filter("Stkcd in ('code', 'none', 'z')").count() == 0
            assert [tuple(r) for r in got.filter("Opnprc is not null").collect()] == [("8", "2024-01-05", None, "2.5")]
            rows = ingest.vendor_rows(got)
            assert rows.count() == 2002 and rows.filter("stock_code = '000007'").count() == 2
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rewritten_tables_have_small_row_groups_that_are_skipped(spark, tmp_path):
    spark.range(20_000).selectExpr("lpad(cast(id % 100 as string), 6, '0') as stock_code", "cast(id as double) as v").repartition(3).write.parquet(str(tmp_path / "a"))
    size = sinks.stored_bytes(spark, str(tmp_path / "a"))
    path, n = sinks.recompressed(spark, str(tmp_path / "a"), str(tmp_path / "b"), ["stock_code"], group_rows=1000, file_bytes=size // 2)
    parts = [pq.ParquetFile(f).metadata for f in Path(path).rglob("*.parquet")]
    assert n == 20_000 and 2 <= len(parts) <= 3
    assert all(m.row_group(i).num_rows <= 1000 for m in parts for i in range(m.num_row_groups)) and sum(m.num_row_groups for m in parts) >= 20
    assert all(m.row_group(i).column(0).compression == "ZSTD" for m in parts for i in range(m.num_row_groups))
    hit = spark.read.parquet(path).filter("stock_code = '000007'")
    assert 200 <= scan_metrics(hit)("numOutputRows") <= 2000 and hit.count() == 200


def test_queries_of_stored_tables_read_back(spark):
    got = catalogue.QUERIES["b8_compacted_partitions"](spark, DATA)
    assert got.filter("n_dropped = 0").count() == 0
