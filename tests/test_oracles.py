"""Every registered query beside its SQL twin on the small data."""

import pytest

import workload
from tests.conftest import SMALL
from workload.compare import compare, duck

QUERIES, ORACLES = workload.all_queries(), workload.all_oracles()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_twins_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"search_vector_ann"}


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_its_twin(spark, con, key):
    ok, note = compare(spark, con, key, QUERIES[key], ORACLES[key], SMALL)
    assert ok, note
