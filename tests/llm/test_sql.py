"""Queries on corpora that SQL can express agree with it on the smallest test tables."""

import pytest

pytest.importorskip("duckdb")

from tablewise.llm.queries import ORACLES, QUERIES

from ..check_oracles import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) is None


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
