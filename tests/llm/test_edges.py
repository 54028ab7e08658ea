"""Every llm query on empty tables, rows of nulls, clashing columns, and a text of one very long unit."""

import pytest
from pyspark.sql import functions as F

from quern.llm import mojibake, queries
from tests.edges import EMPTY, NULLS, write_tables

DOCUMENT_ROWS = {"p8_packing": 0, "p9_mixture": 0, "p10_found": 0, "p10_restored": 0}


@pytest.fixture(scope="module", params=[EMPTY, NULLS])
def tables(request, spark, tmp_path_factory):
    return write_tables(spark, tmp_path_factory.mktemp(request.param), request.param)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_and_null_tables(spark, tables, name):
    got = queries.QUERIES[name](spark, tables).collect()
    if name == "p9_shares":
        assert {r.actual_share for r in got} <= {0.0}
    elif name == "p8_fill":
        assert got == []
    elif name in ("p9_checks", "p10_checks"):
        assert all(r[-1] for r in got)
    else:
        assert len(got) == DOCUMENT_ROWS.get(name, 0)


def test_long_units_are_garbled_whole(spark, monkeypatch):
    monkeypatch.setattr(mojibake, "HELD_CHARS", 5000)
    long = "журнал" * 200 + "ошибка"
    bad = long.encode().decode("cp866")
    df = spark.createDataFrame([*((k, f"    {long}") for k in range(3)), (9, f"    {bad}")], "doc_id bigint, text string").withColumn("is_run", F.lit(True))
    restored = mojibake.restored_documents(df).collect()
    assert [(r.doc_id, r.restored) for r in restored] == [(9, f"    {long}")]
