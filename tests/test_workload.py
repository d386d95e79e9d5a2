"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest

import __spark_entry__ as spark_entry
import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", list(spark_entry.queries()))
def test_query(spark, con, name):
    ok, text = check.compare(spark, con, name, SF)
    assert ok, text


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0


def test_every_counterpart_has_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())
