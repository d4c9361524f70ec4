"""Every query with SQL gives the same rows as DuckDB; the others run."""

import pytest
from oracle import same

from lexiforge.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLE:
        assert same(df, catalog.ORACLE[name], sf) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
