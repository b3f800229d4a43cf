"""Every registered query of the package against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from spanweave import registry
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = registry.QUERIES[name](spark, sf_dir)
    if name in registry.ORACLE_SQL:
        assert compare(df, con, registry.ORACLE_SQL[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
