"""Every registered query against its SQL twin."""

import compare
import pytest

import __spark_entry__ as entry
from twinscout.workload.oracles import ORACLES
from twinscout.workload.queries import REGISTRY as QUERIES


@pytest.fixture(scope="module")
def connection(sf_dir):
    return compare.duck(sf_dir)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, connection, name):
    result = QUERIES[name](spark, sf_dir)
    assert compare.differences(result, connection.sql(ORACLES[name])) is None


def test_entry_gives_the_flagship_rows(spark):
    assert entry.entry(spark).count() == 10
