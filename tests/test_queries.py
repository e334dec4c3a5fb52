"""Registered queries against their SQL twins, all of them."""

import pytest

from larder.operators.inventory import priority_queue
from larder.registry import ORACLES, QUERIES, Fixture
from tests.compare import compare, connect
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def oracle():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SMALL)
    if name in ORACLES:
        assert compare(df, oracle, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_every_query_has_a_twin_unless_it_fits_a_model():
    fits = {n for n in QUERIES if n not in ORACLES}
    assert all(n.startswith("m") for n in fits) and len(fits) == 11


def test_entry_is_ordered_by_priority(spark):
    scores = [r["reorder_priority_score"] for r in priority_queue(Fixture(spark, SMALL).inventory).collect()]
    assert scores == sorted(scores, reverse=True)
