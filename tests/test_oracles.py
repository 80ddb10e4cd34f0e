"""Every forecasting query against its DuckDB twin."""

import math

import duckdb
import pytest

from millrace.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if not hasattr(v, "hour") or (v.hour, v.minute, v.second, v.microsecond) == (0, 0, 0, 0) else v.isoformat()
    return f"{v + 0.0:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_twin(spark, duck, sf_dir, name):
    ours = QUERIES[name](spark, sf_dir)
    cols = sorted(ours.columns)
    theirs = duck.execute(ORACLES[name])
    names = [d[0] for d in theirs.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in order) for r in theirs.fetchall())
    got = sorted(tuple(plain(r[c]) for c in cols) for r in ours.collect())
    assert len(got) == len(want) and got
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or abs(float(x) - float(y)) < 2e-5, (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
