"""Every registered query that SQL can express, on the smallest test tables, against DuckDB."""

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from pagelore import queries as core

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in DATA.iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = core.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(core.oracle_sql()[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = Counter(tuple(plain(row[names.index(c)]) for c in cols) for row in res.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_runs_without_sql(spark, name):
    df = core.queries()[name](spark, str(DATA))
    assert df.columns
    df.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
