"""Every registered query that SQL can express against DuckDB on the smallest tables; the others run."""

import datetime
import decimal
import math

import duckdb
import pytest

from shelfline.plans import registry

from .conftest import TESTDATA

TABLES = "region nation customer supplier part orders lineitem events".split()
NAMES = sorted(registry.queries())


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return None if isinstance(v, float) and math.isnan(v) else v


def near(a, b):
    return abs(a - b) <= 1e-6 * max(1, abs(a), abs(b)) if isinstance(a, float) and isinstance(b, (int, float)) else a == b


def order(row):
    return [(v is None, f"{v:.3f}" if isinstance(v, float) else str(v)) for v in row]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TESTDATA}/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=order)
    if name in registry.oracle_sql():
        cursor = duck.execute(registry.oracle_sql()[name])
        named = [d[0] for d in cursor.description]
        assert sorted(named) == columns
        want = sorted(([plain(dict(zip(named, r))[c]) for c in columns] for r in cursor.fetchall()), key=order)
        assert len(got) == len(want)
        assert all(near(a, b) for x, y in zip(got, want) for a, b in zip(x, y))


def test_entry_can_be_listed_and_run(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
