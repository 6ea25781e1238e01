"""Every registered query against its SQL on the smallest driver tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def canonical(frame):
    def text(value):
        if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
            return "null"
        if isinstance(value, (int, float)) or hasattr(value, "dtype"):
            return f"{float(value):.6f}"
        return str(value)

    ordered = frame[sorted(frame.columns)]
    return sorted(tuple(text(v) for v in row) for row in ordered.itertuples(index=False, name=None))


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    ranked = entry.entry(spark)
    assert ranked.columns == ["pred", "val", "p_cov", "n_cov", "gain"] and ranked.count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    expected = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert canonical(got) == canonical(expected)


RULE_REPORTS = [n for n in sorted(entry.queries()) if n not in entry.oracle_sql() and "learn_" in n]


@pytest.mark.parametrize("name", RULE_REPORTS)
def test_learners_return_rules_that_cover_cases(spark, name):
    rows = entry.queries()[name](spark, SF_DIR).collect()
    rules = [r for r in rows if r["p_cov"] is not None]
    assert all(r["p_cov"] > 0 for r in rules)
