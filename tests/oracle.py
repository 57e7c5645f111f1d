"""Compares a query with its SQL on one data folder, regardless of the order of rows and columns."""

import math
from pathlib import Path

import duckdb
import pandas as pd

FOLDER = Path("/root/testdata/sf0.001")


def connection():
    con = duckdb.connect()
    for f in sorted(FOLDER.glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if hasattr(value, "item") and not isinstance(value, str):
        value = value.item()
    if isinstance(value, bool):
        return str(value)
    return f"{float(value):.6g}" if isinstance(value, int | float) else str(value)


def rows(table):
    table = table[sorted(table.columns)]
    return sorted(tuple(plain(v) for v in r) for r in table.itertuples(index=False))


def same(spark, query, sql):
    got, expected = query(spark, str(FOLDER)), connection().sql(sql).df()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = got.toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
