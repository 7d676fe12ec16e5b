"""Every query with SQL gives what the SQL gives on the small tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from parlance.oracles import ORACLES
from parlance.queries import QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    found = duckdb.connect()
    for path in Path(DIR).glob("*.parquet"):
        found.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    yield found
    found.close()


def value(x):
    if x is None or x is pd.NA or x is pd.NaT or x != x:
        return None
    try:
        return round(float(x), 6) + 0.0
    except (TypeError, ValueError):
        return str(x)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, tables, name):
    found, expected = QUERIES[name](spark, DIR).toPandas(), tables.execute(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
