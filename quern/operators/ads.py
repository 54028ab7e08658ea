"""Click attribution, click-through features, response times and filtered exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import agent_tokens, first_octets
from ..functions.times import elapsed_seconds, ms_to_text, partition_window

FIELDS = ("requestBeginTime", "adId", "impressionId", "referrer", "userAgent", "userCookie", "ip")


def click_join(impressions: DataFrame, clicks: DataFrame, start: str, end: str, clicks_end: str, lower_inclusive: bool = False, dedupe_clicks: bool = False) -> DataFrame:
    """Impressions of a partition window with ``clicked``: whether a click of the (longer) click window names them.

    Repeated clicks repeat the impression unless ``dedupe_clicks``. Ids are compared as they are; an impression
    without an id was not clicked. The begin time becomes 'yyyy-MM-dd HH:mm:ss' (null if it is no number).
    """
    seen = impressions.where(partition_window(F.col("dt"), start, end, lower_inclusive)).select(ms_to_text(F.col("requestBeginTime")).alias("requestBeginTime"), *FIELDS[1:])
    hits = clicks.where(partition_window(F.col("dt"), start, clicks_end, lower_inclusive) & F.col("impressionId").isNotNull()).select(F.col("impressionId").alias("hit"))
    hits = hits.distinct() if dedupe_clicks else hits
    return seen.join(hits, seen["impressionId"] == hits["hit"], "left").select(*FIELDS, F.col("hit").isNotNull().alias("clicked"))


def clicked_counts(joined: DataFrame) -> DataFrame:
    return joined.groupBy("clicked").agg(F.count(F.lit(1)).alias("n"))


def feature_index(joined: DataFrame) -> DataFrame:
    """(feature, ad_id, clicked_percent): the click rate of each ad for each feature of the request.

    Features: 'ua:' + each token of the user agent (repeats count), 'ip:' + the first two octets (nothing
    after the colon if there are none), 'page:' + the referrer; lower-cased. A null ``clicked`` counts as a
    row without a click; rows whose field is null have no such feature but for 'ip:', whose text is null too.
    """
    rows = joined.select(F.col("adId").alias("ad_id"), F.when(F.col("clicked"), 1).otherwise(0).alias("hit"), "userAgent", "ip", "referrer")
    features = F.concat(
        F.transform(F.coalesce(agent_tokens(F.col("userAgent")), F.array().cast("array<string>")), lambda t: F.concat(F.lit("ua:"), F.trim(F.lower(t)))),
        F.array(F.concat(F.lit("ip:"), first_octets(F.col("ip"))), F.concat(F.lit("page:"), F.lower("referrer"))),
    )
    each = rows.select("ad_id", "hit", F.explode(features).alias("feature")).where("feature is not null")
    return each.groupBy("feature", "ad_id").agg((F.sum("hit") / F.count(F.lit(1))).alias("clicked_percent"))


def request_times(requests: DataFrame, date: str | None = None, parity: bool = False) -> DataFrame:
    """(requestTime seconds, hostname) of requests with begin and end in milliseconds; optionally of one partition."""
    rows = requests if date is None else requests.where(F.col("dt") == date)
    return rows.select(elapsed_seconds(F.col("requestBeginTime"), F.col("requestEndTime"), parity).alias("requestTime"), "hostname")


def response_stats(times: DataFrame, *, finite: bool = True) -> DataFrame:
    """(hostname, tmax, tmin, tavg) per host and, as hostname 'ALL', over all rows, in one pass.

    Null times don't count; NaN and infinite ones only if ``finite`` is off. A null hostname is a group.
    Without rows there is no group, not even 'ALL'.
    """
    rows = times.where(F.abs("requestTime") < float("inf")) if finite else times
    stats = rows.groupingSets([[], [F.col("hostname")]], "hostname").agg(
        F.max("requestTime").alias("tmax"), F.min("requestTime").alias("tmin"), F.avg("requestTime").alias("tavg"), F.grouping("hostname").alias("whole"))
    return stats.select(F.when(F.col("whole") == 1, "ALL").otherwise(F.col("hostname")).alias("hostname"), "tmax", "tmin", "tavg")


def filtered_impressions(impressions: DataFrame, referrer: str, agent: str, start: str, end: str) -> DataFrame:
    """The seven fields of a window's impressions from one referrer whose user agent holds a text; the lower bound is included."""
    kept = impressions.where(partition_window(F.col("dt"), start, end, True) & (F.col("referrer") == referrer) & F.contains("userAgent", F.lit(agent)))
    return kept.select(ms_to_text(F.col("requestBeginTime")).alias("requestBeginTime"), *FIELDS[1:])
