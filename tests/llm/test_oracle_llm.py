"""The operators that SQL can express, over whole tables."""

import glob
import os

import duckdb
import pytest

from insight_spark.llm.queries import all_oracles, all_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    df = all_queries()[name](spark, SF)
    want = con.execute(all_oracles()[name])
    columns = sorted(c[0] for c in want.description)
    assert sorted(df.columns) == columns
    places = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted(tuple(r) for r in df.select(columns).collect()) == sorted(tuple(r[i] for i in places) for r in want.fetchall())
