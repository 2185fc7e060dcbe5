"""Queries with SQL against it, and the registration of all."""

import os
import re

import pytest

import __spark_entry__
from workload.check import compare, duckdb_over

SF_DIR = "/root/testdata/sf0.001"


def test_each_operator_has_a_query():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["op6_exact_top_k", "op9_chat_perspectives", "op11_pair_bound_search", "op13_merkle_manifest"])
def test_sql(spark, name, monkeypatch):
    import workload.check as check

    monkeypatch.setattr(check, "QUERIES", __spark_entry__.queries())
    monkeypatch.setattr(check, "SQL", __spark_entry__.oracle_sql())
    assert compare(spark, duckdb_over(SF_DIR), name, SF_DIR) == ""
