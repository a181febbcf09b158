"""Every registered query against its oracle SQL on the smallest data that gives it rows."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract

FOLDERS = ("/root/testdata/sf0.001", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
ORACLE = contract.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDERS[0]), reason="no test data")


@pytest.fixture(scope="module")
def ducks():
    found = {}
    for folder in FOLDERS:
        found[folder] = duckdb.connect()
        for t in TABLES:
            found[folder].execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return found


def cell(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "null"
    if isinstance(x, numbers.Number) and not isinstance(x, bool):
        return repr(float(x) + 0.0)
    return str(x)


def table(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(cell(x) for x in r) for r in df[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, ducks, name):
    for folder, duck in ducks.items():
        want = table(duck.execute(ORACLE[name]).df())
        if want[1]:
            break
    # Two empty results are equal whatever the query does.
    assert want[1], "the oracle finds no rows"
    assert table(contract.queries()[name](spark, folder).toPandas()) == want


def test_queries_without_sql_are_the_training_data_operators():
    """Those have their brute-force tests in their own folder; every other query has SQL."""
    without = set(contract.queries()) - set(ORACLE)
    assert all(name == "pipeline" or name.startswith("op") for name in without)
    assert set(ORACLE) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
