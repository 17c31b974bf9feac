"""Every query that SQL can express, against DuckDB."""

import pytest
from compare import DATA, same_result

from kelpwood.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, duck, name):
    same_result(registry.QUERIES[name](spark, DATA), duck.sql(registry.SQL[name]))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry_imports_without_the_corpus_operators():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
