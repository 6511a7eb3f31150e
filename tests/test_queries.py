"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from areacast.plans.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows and all(None not in r for r in rows)
        return
    expected = db.sql(f"SELECT {', '.join(columns)} FROM ({sql})")
    assert ordered(rows) == ordered(expected.fetchall())
    assert [TYPES[df.schema[c].dataType.simpleString()] for c in columns] == [
        str(t) for t in expected.types
    ]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["abb", "estimate", "truth"] and df.count() == 25
