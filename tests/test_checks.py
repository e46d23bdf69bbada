"""Every registered query against its SQL twin on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry
from checks import queries as registered
from checks import sql as twins
from checks.compare import compare, duck

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_all_queries_have_a_twin():
    assert set(registered.ALL) == set(twins.ALL)


@pytest.mark.parametrize("name", sorted(registered.ALL))
def test_query_equals_sql(spark, connection, name):
    df = registered.ALL[name](spark, SF_DIR)
    assert len(set(df.columns)) == len(df.columns)
    rows, problems = compare(df, connection, twins.ALL[name])
    assert not problems
    assert rows > 0 or name in {"cohorts"}


def test_entry_keeps_its_schema(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["rank", "entity_type", "entity_id"] and df.count() > 0


def test_ranks_are_a_permutation(spark):
    ranks = [r["rank"] for r in registered.ALL["ranked_records"](spark, SF_DIR).collect()]
    assert sorted(ranks) == list(range(1, len(ranks) + 1))
