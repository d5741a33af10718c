"""Every query of the library that SQL can express, against that SQL."""

import pytest

from medialens.plans import catalogue
from tests.oracle import difference

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert difference(spark, catalogue.queries()[name], SQL[name], sf_dir) == ""


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["group_id", "image_id", "is_canonical", "distance"]
