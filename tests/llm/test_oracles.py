"""Queries of the subpackage that SQL can express, against that SQL."""

import pytest

from medialens.llm import registry
from tests.oracle import difference

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert difference(spark, registry.queries()[name], SQL[name], sf_dir) == ""


def test_every_operator_has_a_query():
    names = list(registry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in names
