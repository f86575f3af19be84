"""Every query of the training-data operators on the smallest tables, against its SQL where there is one."""

import pytest
from check_queries import compare, connect

from deckloom.llm.queries import CHECKS, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(spark, name):
    ok, text = compare(spark, connect(SF_DIR), name, QUERIES[name], CHECKS[name], SF_DIR)
    assert ok, text


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(CHECKS) <= set(QUERIES)
