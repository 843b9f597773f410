"""Every registered query with SQL gives the rows that DuckDB gives on the smallest tables."""

import glob
import os

import duckdb
import pytest

from strandlight.plans import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 5) + 0.0
    return v if isinstance(v, (bool, int, type(None))) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    ours = sorted(repr(tuple(plain(x) for x in r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    theirs = sorted(repr(tuple(plain(x) for x in r)) for r in relation.select(*[f'"{c}"' for c in columns]).fetchall())
    assert ours == theirs
