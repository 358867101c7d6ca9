"""Every registered core query against its SQL on the smallest tables."""

import pytest

from palimpsest.plans import registry
from tests.compare import duck_rows, rows, views

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return views(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, duck, name):
    cols, got = rows(registry.queries()[name](spark, sf))
    assert got == duck_rows(duck, SQL[name], cols)


def test_entry_has_rows(spark, sf):
    assert registry.FLAGSHIP(spark, sf).count() > 0
