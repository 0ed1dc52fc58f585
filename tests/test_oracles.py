"""Every query with SQL agrees with it on the smallest corpus; every other one runs."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

from quire.plans import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con(small):
    return check.duck(small)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, small, name):
    ok, text = check.compare(spark, con, name, small)
    assert ok, text
