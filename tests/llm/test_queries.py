"""Every training-text query runs, and agrees with its SQL where it has one."""

from __future__ import annotations

import pytest

from factloom.llm import queries as Q
from tests.conftest import DATA
from tests.oracle import connection, rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    cols, got = rows_of(Q.queries()[name](spark, DATA))
    if name.endswith("_found"):
        assert len(set(got)) == len(got)
    sql = Q.oracle_sql().get(name)
    if sql:
        assert (cols, got) == rows_of_sql(connection(DATA), sql)
