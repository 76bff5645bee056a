"""Every named query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from lexsift.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES.split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def same_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    rows = df.collect()
    if name in ORACLE_SQL:
        rel = duck.sql(ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert same_rows(df.columns, rows) == same_rows(rel.columns, rel.fetchall())
    else:
        assert rows
