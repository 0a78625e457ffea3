"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

from millrace.plans import ORACLES, QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, duck, sf_dir):
    if name in ORACLES:
        assert compare(spark, duck, QUERIES[name], ORACLES[name], sf_dir) in (None, "no rows")
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["n_name", "revenue", "n_orders"]
