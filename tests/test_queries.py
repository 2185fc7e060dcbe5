"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import workload
from workload.check import compare, duckdb_over
from workload.registry import QUERIES

workload.load()
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duckdb_over(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, SF_DIR) == ""
