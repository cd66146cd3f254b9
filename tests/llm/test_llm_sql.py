"""The queries with SQL against DuckDB."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import connect, same  # noqa: E402

from millrace.llm import queries  # noqa: E402

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    same(queries.QUERIES[name](spark, D), connect(D), queries.SQL[name])


def test_names(spark):
    assert all(n.startswith(("p1_", "p7_", "p8_", "p9_")) for n in queries.QUERIES)
    assert queries.p9_found(spark, D).columns == ["doc_id", "subject"]
    assert queries.p7_ids(spark, D).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
