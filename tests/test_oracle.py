"""Every query with an SQL twin, compared on the smallest data set."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canonical

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got, columns = canonical([tuple(r) for r in df.collect()], df.columns)
    cursor = db.execute(entry.oracle_sql()[name])
    want, wanted = canonical(cursor.fetchall(), [d[0] for d in cursor.description])
    assert columns == wanted
    assert got == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
