"""Every registered query against its SQL on the same parquet files."""

import datetime as dt
import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry
from catalog.oracle import all_oracles as oracle_sql
from catalog.queries import all_queries as queries

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else value + 0.0
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    return value


def sorted_rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def test_keys():
    assert set(oracle_sql()) <= set(queries())
    assert sorted(set(queries()) - set(oracle_sql())) == [
        "deep_profile", "n_unique_approx", "report_markdown_lines",
    ]


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    want = duck.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    types = {c: str(t[1]) for c, t in zip(columns, want.description)}
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert queries()[name](spark, SF).count() > 0
