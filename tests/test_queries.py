"""Every query against its oracle in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from boxlake.plans.queries import ORACLE_SQL, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"create view {name} as select * from '{DIR}/{name}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v if v is None or isinstance(v, (int, str, bool)) else (float(v) if type(v).__name__ == "Decimal" else str(v))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    got = df.select(*sorted(df.columns)).toPandas().astype(object)
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    names = sorted(rel.columns)
    want = [tuple(r[rel.columns.index(n)] for n in names) for r in rel.fetchall()]
    exact = lambda v: v if not isinstance(v, float) else round(v, 2)
    rows = lambda x: sorted((tuple(map(norm, r)) for r in x), key=lambda t: (str([v for v in t if not isinstance(v, float)]), [exact(v) or 0 for v in t if isinstance(v, float)]))
    a, e = rows(df.select(*names).collect()), rows(want)
    assert len(a) == len(e) and len(got) == len(e)
    close = lambda p, q: p == q or (isinstance(p, float) and isinstance(q, (int, float)) or isinstance(q, float) and isinstance(p, int)) and math.isclose(p, q, rel_tol=1e-6, abs_tol=1e-9)
    bad = [(x, y) for x, y in zip(a, e) if not all(map(close, x, y))]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
