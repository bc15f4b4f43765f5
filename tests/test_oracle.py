"""Every query with SQL against DuckDB."""

from __future__ import annotations

import pytest

from tessera import queries as Q
from tests.compare import connect, differences

NAMES = sorted(Q.oracle_sql())


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, con, name):
    assert not differences(Q.queries()[name](spark, sf_dir), con, Q.oracle_sql()[name])


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
