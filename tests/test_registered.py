"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from tablescout.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(registry.QUERIES))
def test_query(spark, con, key):
    sql = entry.oracle_sql().get(key)
    if not sql:
        assert key in {"int_entity_words", "int_entity_visits", "prof_sketches"}, f"{key} has no SQL twin"
        assert entry.queries()[key](spark, SF).count() > 0
        return
    message, _ = compare(spark, key, entry.queries()[key], sql, SF, con)
    assert message == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 1500
