from __future__ import annotations

import pytest

from archweave.llm import queries
from tests.harness import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    assert difference(spark, queries.queries()[name], queries.oracle_sql()[name], SF) is None
