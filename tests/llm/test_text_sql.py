"""The text queries that SQL can express give DuckDB's rows."""

import glob
import os

import duckdb
import pytest

from strandlight.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    relation = con.sql(ORACLES[name])
    df = QUERIES[name](spark, SF).select(*relation.columns)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, relation.fetchall()))
