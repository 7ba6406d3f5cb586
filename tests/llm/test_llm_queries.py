from __future__ import annotations

import pytest

from oracle import assert_same
from provenlake.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


