"""Reports over access and CDN logs. Frames that several reports read should be cached by the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import logs as L
from ..functions.text import full_match
from ..functions.times import bucket_name, hour_of_day, time_bucket
from .counting import top, totals, whole_sum

# Fixed value: referrers of the site itself, which the external list leaves out.
OWN_HOST = r".*example\.org"


def bad_lines(parsed: DataFrame) -> DataFrame:
    """One row: lines in all, and those that don't follow the layout."""
    return parsed.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("remoteAddr").isNull()).alias("bad_lines"))


def hourly_traffic(logs: DataFrame) -> DataFrame:
    """(hour 'HH' UTC, num_requests, num_bytes), all days folded; unparsed rows and rows without a time are left out."""
    return totals(logs.where("dtime is not null"), hour_of_day(F.col("dtime")), "hour", num_bytes="bytes")


def top_blocks(logs: DataFrame, n: int = 50) -> DataFrame:
    """(block 'a.b.c.*', num_requests, num_bytes) by requests; other addresses, names among them, are left out."""
    per = totals(logs.select(L.address_block(F.col("remoteAddr")).alias("block"), "bytes").where("block is not null"), F.col("block"), "block", num_bytes="bytes")
    return top(per, "num_requests", n, "block")


def top_referrers(logs: DataFrame, n: int = 50, own: str = OWN_HOST) -> DataFrame:
    """(referrer 'http://host', num_requests), without the site's own; rows without such a host are left out."""
    hosts = logs.select(L.referrer_host(F.col("referrer")).alias("referrer")).where(~full_match(F.col("referrer"), own))
    return top(totals(hosts, F.col("referrer"), "referrer"), "num_requests", n, "referrer")


def top_search_terms(logs: DataFrame, n: int = 50) -> DataFrame:
    """(term, num): raw q= values of referrers that name a search engine."""
    engine = full_match(F.col("referrer"), L.SEARCH_ENGINES[0]) | full_match(F.col("referrer"), L.SEARCH_ENGINES[1])
    terms = logs.where(engine).select(L.search_term(F.col("referrer")).alias("term")).where("term is not null")
    return top(terms.groupBy("term").agg(F.count(F.lit(1)).alias("num")), "num", n, "term")


def access_log_reports(logs: DataFrame, n: int = 50) -> dict[str, DataFrame]:
    """The four access-log reports by name; ``logs`` holds the parsed fields, unparsed lines being all null."""
    kept = logs.where("remoteAddr is not null")
    return {
        "total_requests_bytes_per_hour": hourly_traffic(kept),
        "top_50_ips": top_blocks(kept, n),
        "top_50_external_referrers": top_referrers(kept, n),
        "top_50_search_terms_from_bing_google": top_search_terms(kept, n),
    }


def field_report(logs: DataFrame, field: str) -> dict[str, DataFrame]:
    """Requests, bytes, and requests by response code of each value of a field, largest first, all keys descending."""
    per = logs.groupBy(field)
    count = per.agg(F.count(F.lit(1)).alias("RequestCount")).orderBy(F.desc("RequestCount"), F.desc(field))
    size = per.agg(whole_sum("Bytes").alias("TotalBytes")).orderBy(F.desc("TotalBytes"), F.desc(field))
    split = logs.groupBy(field, "HTTPResponse").agg(F.count(F.lit(1)).alias("RequestCount")).orderBy(F.desc("RequestCount"), F.desc("HTTPResponse"), F.desc(field))
    return {"request-count": count, "bytes-transferred": size, "request-count-by-httpresponse": split}


def volume_report(logs: DataFrame, bucket_seconds: int = 300) -> dict[str, DataFrame]:
    """Requests, bytes, and requests by response code of each time bucket that has any, in order of time."""
    rows = logs.where("ts is not null").withColumn("BucketedDateTime", bucket_name(time_bucket(F.col("ts"), bucket_seconds)))
    per = rows.groupBy("BucketedDateTime")
    count = per.agg(F.count(F.lit(1)).alias("RequestCount")).orderBy("BucketedDateTime")
    size = per.agg(whole_sum("Bytes").alias("TotalBytes")).orderBy("BucketedDateTime")
    split = rows.groupBy("BucketedDateTime", "HTTPResponse").agg(F.count(F.lit(1)).alias("RequestCount")).orderBy("BucketedDateTime", "HTTPResponse")
    return {"request-count": count, "bytes-transferred": size, "request-count-by-httpresponse": split}


CDN_REPORTS = {"client-ip": "IP", "object-popularity": "Object", "edge-location": "EdgeLocation", "overall-volume": None}


def cdn_reports(logs: DataFrame, reports: list[str] | None = None, bucket_seconds: int = 300) -> dict[str, DataFrame]:
    """'<report>-<measure>' -> frame for the named reports, or for all four if none is named."""
    unknown = set(reports or ()) - set(CDN_REPORTS)
    if unknown:
        raise ValueError(f"unknown reports: {sorted(unknown)}")
    out = {}
    for name in reports or CDN_REPORTS:
        field = CDN_REPORTS[name]
        frames = field_report(logs, field) if field else volume_report(logs, bucket_seconds)
        out |= {f"{name}-{k}": v for k, v in frames.items()}
    return out
