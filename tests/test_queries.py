"""Every registered query of the core library against its SQL."""

from __future__ import annotations

import pytest

from brindle.plans import catalog
from tests.compare import assert_same, connect

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert_same(df, con, SQL[name])
    else:
        assert df.count() > 0
