"""Queries against SQL, and what is registered."""

import re

import pytest
from compare import actual, connect, differences, expected

import __spark_entry__ as entry
from doseframe.llm.oracles import ORACLES
from doseframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_all_are_registered():
    numbered = sorted(int(m[1]) for q in QUERIES if (m := re.match(r"op(\d+)_", q)))
    assert numbered == list(range(1, 14)) and set(QUERIES) <= set(entry.queries()) and set(ORACLES) < set(QUERIES)
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ["op1_decontamination", "op3_phrases", "op9_ngram_join"])
def test_matches_sql(spark, duck, name):
    assert differences(actual(QUERIES[name](spark, SF)), expected(duck, ORACLES[name])) == []
