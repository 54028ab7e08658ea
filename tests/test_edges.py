"""Every numbered query of the core on empty tables, rows of nulls and clashing columns."""

import pytest

from quern.plans import numbered
from tests.edges import EMPTY, NULLS, write_tables

# Null lines are cases, and so are loaded rows without status and bytes; nothing else of null rows is.
NULL_ROWS = {"p2_found": 10, "p2_rejects_by_reason": 2}


@pytest.fixture(scope="module", params=[EMPTY, NULLS])
def tables(request, spark, tmp_path_factory):
    return request.param, write_tables(spark, tmp_path_factory.mktemp(request.param), request.param)


@pytest.mark.parametrize("name", sorted(numbered.QUERIES))
def test_empty_and_null_tables(spark, tables, name):
    kind, where = tables
    assert len(numbered.QUERIES[name](spark, where).collect()) == (NULL_ROWS.get(name, 0) if kind == NULLS else 0)
