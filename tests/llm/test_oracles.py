"""The registered queries against their SQL, on odd rows and on the smallest given tables."""

import os

import duckdb
import pytest

from volframe.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


def from_sql(folder, sql):
    con = duckdb.connect()
    for name in os.listdir(folder):
        at = f"{folder}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{at if os.path.isfile(at) else at + '/*.parquet'}'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    return ordered(cursor.fetchall(), names), sorted(names)


def ordered(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_small(spark, name):
    df = QUERIES[name](spark, SMALL)
    want, names = from_sql(SMALL, ORACLE_SQL[name])
    assert names == sorted(df.columns) and ordered(df.collect(), df.columns) == want


@pytest.mark.parametrize("name", ["op4_url_filters", "op9_warc", "op10_quality_rules"])
def test_odd(spark, tables, name):
    df = QUERIES[name](spark, tables)
    want, _ = from_sql(tables, ORACLE_SQL[name])
    assert ordered(df.collect(), df.columns) == want
