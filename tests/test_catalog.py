"""Every query of the core runs, and agrees with its SQL where it has one."""

from __future__ import annotations

import pytest

from factloom.plans import catalog
from tests.conftest import DATA
from tests.oracle import connection, rows_of, rows_of_sql

NAMES = sorted(catalog.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    cols, got = rows_of(catalog.queries()[name](spark, DATA))
    sql = catalog.oracle_sql().get(name)
    if sql:
        assert (cols, got) == rows_of_sql(connection(DATA), sql)


def test_every_sql_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_core_does_not_import_the_llm_package():
    import pathlib

    import factloom

    root = pathlib.Path(factloom.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            text = p.read_text()
            assert "factloom.llm import" not in text and "import factloom.llm" not in text, p
