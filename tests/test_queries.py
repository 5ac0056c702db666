"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest
from oracle import compare, connect

from strandcheck.plans.registry import all_queries

FOLDER = "/root/testdata/sf0.001"
# With few parts there are only a few barcodes, so no knee is found.
MAY_BE_EMPTY = {"barcode_knee", "user_activity_knee"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(all_queries()))
def test_query(spark, con, name):
    problem = compare(spark, con, name, all_queries()[name], FOLDER)
    assert problem is None or (name in MAY_BE_EMPTY and problem == "equal but empty"), problem


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
