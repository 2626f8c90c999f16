"""Every registered query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from causalake.plans import catalog
from tests.conftest import rows, sql_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    assert rows(df) == sql_rows(duck, catalog.ORACLES[name], df.columns)


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"top_genetic_targets", "census", "identification"} <= set(e.queries())
