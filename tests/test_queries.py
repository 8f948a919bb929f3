"""Every registered query of the library against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from codonspark.plans import catalog, more  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    found = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    # integers and strings order the rows; floats only follow
    order = [i for i, n in enumerate(names) if dict(df.dtypes)[n] != "double"] + [i for i, n in enumerate(names) if dict(df.dtypes)[n] == "double"]
    key = lambda r: [(r[i] is None, r[i] if isinstance(r[i], (int, float)) else 0, str(r[i])) for i in order]
    want = sorted((tuple(r) for r in found.fetchall()), key=key)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=key)
    assert len(got) == len(want)
    assert all(same(x, y) for g, w in zip(got, want) for x, y in zip(g, w))
