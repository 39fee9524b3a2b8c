"""Every query runs and, where there is SQL for it, gives the same rows as DuckDB."""

import datetime
import decimal
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

CORE = [n for n in entry.queries() if entry.queries()[n].__module__.startswith("factloom.plans")]


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{round(float(v), 6) + 0.0:.6f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def compare(spark, root, name):
    df = entry.queries()[name](spark, root)
    rows = df.collect()
    if name not in entry.oracle_sql():
        return
    con = duckdb.connect()
    for t in os.listdir(root):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{root}/{t}'")
    found = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    floats = {c for c, k in df.dtypes if k in ("float", "double") or k.startswith("decimal")}
    show = lambda c, v: plain(float(v) if c in floats and v is not None else v)
    ours = Counter(tuple(show(c, r[c]) for c in order) for r in rows)
    theirs = Counter(tuple(show(c, r[columns.index(c)]) for c in order) for r in found.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", CORE)
def test_query(spark, root, name):
    compare(spark, root, name)


def test_entry(spark, root):
    assert entry.entry(spark).count() > 0
