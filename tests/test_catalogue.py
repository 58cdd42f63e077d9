from __future__ import annotations

import pytest
from .conftest import SMALL, same_rows

import __spark_entry__ as entry
from braidwork.plans import catalogue, widget_tree


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES | widget_tree.ORACLES))
def test_equals_sql(spark, name):
    same_rows(entry.queries()[name](spark, SMALL), entry.oracle_sql()[name], SMALL)


def test_every_query_is_registered():
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
