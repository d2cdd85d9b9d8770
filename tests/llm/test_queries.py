"""The registered queries that have SQL, against it; and what the others promise."""

import zlib

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from tidewatch.llm import queries


def plain(value):
    return None if pd.isna(value) else value if isinstance(value, str) else float(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr([plain(v) for v in r]) for r in frame.itertuples(index=False, name=None))


def test_all_are_registered():
    names = contract.queries()
    assert {"pipeline", *queries.QUERIES} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", queries.SQL)
def test_sql(spark, tables, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tables}/{table}.parquet')")
    got = queries.QUERIES[name](spark, tables).toPandas()
    expected = connection.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", ["op2_toxicity", "op10_quality_classifier"])
def test_scores(spark, tables, name):
    got = queries.QUERIES[name](spark, tables).toPandas()
    texts = spark.read.parquet(f"{tables}/documents.parquet").toPandas()
    assert sorted(got.doc_id) == sorted(texts.doc_id)
    assert got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= (0.7 if "toxic" in name else 0.5))).all()
