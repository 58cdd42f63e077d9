from __future__ import annotations

import pytest

from braidwork.llm import queries

from ..conftest import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SMALL), queries.ORACLES[name], SMALL)
