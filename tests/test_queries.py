"""Every query with SQL against DuckDB on the smallest tables; every other one runs and keeps its schema."""

import re

import pytest
from oracle import connect, same

from millrace import functions
from millrace.plans import engine_queries, function_queries, measurement_queries, stream_queries

D = "/root/testdata/sf0.001"
MODULES = (engine_queries, function_queries, measurement_queries, stream_queries)
ALL = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    same(ALL[name](spark, D), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, name):
    df = ALL[name](spark, D)
    assert df.toArrow().column_names == df.columns


def test_every_function_is_called():
    src = "".join(open(m.__file__).read() for m in (engine_queries, function_queries))
    missing = [n for n in functions.__all__ if not re.search(rf"\bF\.{n}\b", src) and f'"{n}"' not in src]
    assert missing == []
    assert len(functions.__all__) == 232


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
