"""The text operators' queries that have SQL, side by side with DuckDB on the smallest tables."""

import pytest

from saunter.llm import registry
from tests.test_queries import SF, duck  # noqa: F401  (duck is a fixture)


def rows(columns, found):
    """Rows as text by sorted column names, from values as they are: pandas would make numbers with nulls floats."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str([r[k] for k in order]) for r in found)


@pytest.mark.parametrize("name", registry.ORACLES)
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    got, want = registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
