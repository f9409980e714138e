"""Every core query runs, and equals its SQL where it has one."""

import os

import pytest

from foliospark.plans.catalog import catalog
from tests.compare import DATA, rows_of, sql_rows

REGISTRY = catalog()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_query(spark, name):
    names, rows = rows_of(REGISTRY.queries[name](spark, DATA))
    assert len(set(names)) == len(names)
    if name in REGISTRY.sql:
        assert rows == sql_rows(REGISTRY.sql[name], names)


def test_entry():
    import __spark_entry__ as entry

    assert set(REGISTRY.queries) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
