"""Every query with SQL gives DuckDB's rows over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import terrafold.plans.more_queries  # noqa: F401
from terrafold.plans.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(values, columns):
    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, bool):
            return v
        if isinstance(v, (int, float)):
            return round(float(v), 5) + 0.0
        return str(v)

    return sorted((tuple(plain(r[c]) for c in columns) for r in values), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    want = duck.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    have = [r.asDict() for r in got.collect()]
    hold = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    a, b = rows(have, columns), rows(hold, columns)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y or all(p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-6, abs_tol=2e-5)) for p, q in zip(x, y, strict=True))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    """Without SQL: the tracker, which test_whole_tables.py and test_frames.py hold against plain Python."""
    assert name == "ST-01_tracker" and QUERIES[name](spark, str(DATA)).count() == spark.read.parquet(str(DATA / "events.parquet")).count()
