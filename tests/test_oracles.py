"""Every registered query of the library's own operators against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from volframe.plans.registry import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in os.listdir(DIR):
        con.execute(f"CREATE VIEW {p.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{p}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([r[i] for i in order] for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DIR)
    rows = df.collect()
    assert rows
    if name in ORACLE_SQL:
        cursor = db.execute(ORACLE_SQL[name])
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns)
        ours, theirs = plain(rows, df.columns), plain(cursor.fetchall(), names)
        assert len(ours) == len(theirs)
        assert all(same(x, y) for r, q in zip(ours, theirs, strict=True) for x, y in zip(r, q, strict=True))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(QUERIES) <= set(__spark_entry__.queries())
