"""Every registered query against its DuckDB oracle on the smallest scale (the driver's gate uses sf0.01)."""

import pytest

from conftest import SF_SMALL

from lexiprop.plans.registry import all_oracles, all_queries
from oracle_harness import compare, duck

QUERIES = all_queries()
ORACLES = all_oracles()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    problems, _ = compare(QUERIES[name](spark, SF_SMALL), con, ORACLES[name])
    assert not problems, problems


def test_every_query_has_an_oracle_except_trainers():
    assert set(QUERIES) - set(ORACLES) == {"embed_glove", "expansion_end_to_end"}
