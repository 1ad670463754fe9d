"""Every query with an SQL form gives the same rows as DuckDB; every other one gives rows."""

import math

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SLOW = {
    "fit_random_forest", "fit_gradient_boosting", "fit_random_forest_regressor", "fit_gradient_boosting_regressor",
    "fit_decision_tree", "fit_decision_tree_regressor", "fit_svm", "fit_svr", "cross_validate", "train_all",
    "train_all_regression",
}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return repr(v + 0.0) if isinstance(v, float) else str(v)


def _rows(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(map(_cell, r)) for r in zip(*[table.column(n).to_pylist() for n in names]))


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_as_sql(spark, sf, duck, name):
    got = contract.queries()[name](spark, sf).toArrow()
    want = duck.sql(contract.oracle_sql()[name]).to_arrow_table()
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql()) - SLOW))
def test_gives_rows(spark, sf, name):
    assert contract.queries()[name](spark, sf).count() > 0


def test_entry_runs(spark):
    assert contract.entry(spark).count() == 4
