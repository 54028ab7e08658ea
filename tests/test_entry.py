"""The registered queries: names, and agreement with their SQL on the smallest tables, if these are there."""

import os

import pytest

import __spark_entry__ as entry
from quern.plans import files, numbered, reports
from tools.compare import compare

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLE = numbered.QUERIES | reports.QUERIES | files.QUERIES, numbered.ORACLE | reports.ORACLE | files.ORACLE


def test_names():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert len(QUERIES) > 40


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    result = compare(spark, name, QUERIES[name], ORACLE[name], SMALL)
    assert ": ok," in result, result
