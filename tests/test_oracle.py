"""Every core query against its SQL on the smallest tables."""

import pytest

from engramlake.plans import REGISTERED
from tests.oracle import compare, duck

#: What the smallest tables hold no case of; these are compared on the next ones.
RARE = set()
ORACLE = {k: (m.QUERIES[k], q) for m in REGISTERED for k, q in m.ORACLE.items()}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.fixture(scope="module")
def con10(sf_dir):
    return duck(sf_dir.replace("sf0.001", "sf0.01"))


@pytest.mark.parametrize("name", ORACLE)
def test_same_as_sql(spark, con, con10, sf_dir, name):
    query, sql = ORACLE[name]
    said = compare(spark, con, name, query, sql, sf_dir)
    if said == "no rows on either side" and name in RARE:
        said = compare(spark, con10, name, query, sql, sf_dir.replace("sf0.001", "sf0.01"))
    assert said == ""


def test_every_query_is_registered_once():
    names = [k for m in REGISTERED for k in m.QUERIES]
    assert len(names) == len(set(names))
