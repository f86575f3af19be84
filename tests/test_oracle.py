"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from check_queries import compare, connect
from check_types import mismatches

from deckloom.plans import CHECKS, QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, text = compare(spark, con, name, QUERIES[name], CHECKS.get(name), SF_DIR)
    assert ok, text


@pytest.mark.parametrize("name", ["ag01_slide_features", "ag21_average_scores", "jn16_invariant_pairs", "wn15_align_shapes"])
def test_types(spark, con, name):
    assert mismatches(QUERIES[name](spark, SF_DIR), con, CHECKS[name]) == []


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)
