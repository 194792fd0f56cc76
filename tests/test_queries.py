"""Core queries against their SQL over the whole small tables."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from corpusloom import queries as core

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    try:
        f = float(v)
        return "nan" if math.isnan(f) else round(f, 5)
    except (TypeError, ValueError):
        return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = core.queries()[name](spark, str(DATA))
    r = duck.execute(core.oracle_sql()[name])
    columns = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, r.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(core.queries().keys() - core.oracle_sql().keys()))
def test_runs(spark, name):
    assert core.queries()[name](spark, str(DATA)).count() >= 0
