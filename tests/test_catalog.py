"""Every registered query on the small tables, against the SQL registered with it."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract

FOLDER = os.environ.get("TIDEWATCH_TABLES", contract.SMALL)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in ("lineitem", "events", "embeddings"):
        path = f"{FOLDER}/{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value):
    if pd.isna(value):
        return None
    return value if isinstance(value, str) else float(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr([plain(v) for v in r]) for r in frame.itertuples(index=False, name=None))


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", contract.catalog.QUERIES)
def test_query(spark, database, name):
    got = contract.queries()[name](spark, FOLDER).toPandas()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    expected = database.execute(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
