"""Each query that has an SQL twin gives the same rows as DuckDB."""

import math

import duckdb
import pytest

from tessera.queries import load

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = load()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


def rows(found):
    return sorted((tuple(map(plain, r)) for r in found), key=lambda r: [(x is None, str(type(x)) if isinstance(x, str) else "", str(x) if isinstance(x, tuple) else x if x is not None else 0) for x in r])


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, db, name):
    df, sql = QUERIES[name](spark, D), db.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(sql.columns)
    assert rows(df.select(*cols).collect()) == rows([tuple(r[sql.columns.index(c)] for c in cols) for r in sql.fetchall()])
