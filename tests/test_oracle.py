"""Every registered query next to its SQL twin, on the smallest data set."""

import os
import sys

import pytest
from conftest import SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import __spark_entry__ as se  # noqa: E402
from check_oracle import compare, connect  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(se.oracle_sql()))
def test_query(spark, duck, name):
    got = se.queries()[name](spark, SMALL).toPandas()
    assert len(got)
    assert compare(got, duck.execute(se.oracle_sql()[name]).df()) is None


def test_names():
    assert set(se.oracle_sql()) <= set(se.queries())


def test_entry(spark):
    assert se.entry(spark).count() == 30
