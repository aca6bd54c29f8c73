"""Every query with SQL gives what DuckDB gives."""

import math

import duckdb
import pandas as pd
import pytest

from barloom.queries import ORACLES, QUERIES


def rows(frame, columns):
    def plain(x):
        if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return None
        return x if isinstance(x, str) else float(x) + 0.0

    return sorted([tuple(plain(x) for x in r) for r in frame[columns].astype(object).itertuples(index=False)], key=repr)


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for name in ("events", "orders", "customer", "part", "lineitem"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, tables, name):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), tables.sql(ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a, b = rows(ours, columns), rows(theirs, columns)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(u == v or isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 2e-6 * max(1, abs(u)) for u, v in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"all_indicators", "search_scores", "search_execution", "search_top", "search_study", "search_fronts", "rf_importance", "importance_ranking", "threshold_search"}))
def test_runs(spark, sf, name):
    assert len(QUERIES[name](spark, sf).schema.fields) > 1
    QUERIES[name](spark, sf).count()
