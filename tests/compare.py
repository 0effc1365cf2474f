"""Order-insensitive comparison of a Spark result with DuckDB's."""

import os

import duckdb
import pandas as pd

GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in GIVEN:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con.execute(sql).df()


def shown(x) -> str:
    if pd.api.types.is_scalar(x) and pd.isna(x):
        return "null"
    if isinstance(x, float):
        return f"{x:.6g}"
    return str(x).removesuffix(" 00:00:00")


def rows(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    numeric = {c for c in columns if pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c])}
    values = [[shown(float(x)) if c in numeric and not pd.isna(x) else shown(x) for x in df[c]] for c in columns]
    return sorted(zip(*values, strict=True)) if columns else []


def assert_same(spark_df, sql: str, sf_dir: str) -> None:
    got, want = spark_df.toPandas(), oracle(sql, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
