"""Every query of the engine's own operators against its SQL in DuckDB."""

import pytest

from tracewell.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(compare, name):
    compare(catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
