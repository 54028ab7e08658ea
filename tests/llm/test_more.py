"""Certificates are the same whether the estimates are broadcast or joined by a shuffle."""

from quern.llm import digests
from tests.conftest import rows
from tests.llm.test_sketches import metric_rows


def test_certificates_without_broadcast(spark):
    df = spark.createDataFrame(metric_rows(7, 2000), "hostname string, dt string, value double").coalesce(1)
    small = rows(digests.certified_percentiles(df, ["hostname", "dt"]))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(digests.certified_percentiles(df, ["hostname", "dt"])) == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
