"""Text queries against their SQL on the smallest tables."""

import pytest

from engramlake.llm.queries import ORACLE, QUERIES
from tests.oracle import compare, duck


@pytest.mark.parametrize("name", ORACLE)
def test_same_as_sql(spark, sf_dir, name):
    assert compare(spark, duck(sf_dir), name, QUERIES[name], ORACLE[name], sf_dir) == ""
