"""Every registered query against its SQL on the given tables."""

import pytest
from compare import TESTDATA, connect, differences

import __spark_entry__ as entry_module
from workmill.plans import registry

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
FOLDER = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con):
    assert differences(QUERIES[name](spark, FOLDER), con, ORACLES[name]) == []


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
