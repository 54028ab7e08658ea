"""Schemas of the records this library reads and writes."""

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}[t]) for n, t in (x.split() for x in spec.split(", "))])


IMPRESSION = _struct("requestBeginTime string, adId string, impressionId string, referrer string, userAgent string, userCookie string, ip string")
IMPRESSION_TIMING = _struct("requestBeginTime string, requestEndTime string, hostname string")
CLICK = _struct("impressionId string")
JOINED_IMPRESSION = T.StructType([*IMPRESSION.fields, T.StructField("clicked", T.BooleanType()), T.StructField("day", T.StringType()), T.StructField("hour", T.StringType())])
FEATURE_INDEX = _struct("feature string, ad_id string, clicked_percent double")
LOCAL_METRIC = _struct("requestTime double, hostname string")
ACCESS_LOG = _struct("remoteAddr string, remoteLogname string, user string, time string, request string, status int, bytes_string string, referrer string, browser string, dtime timestamp, bytes bigint")
CDN_LOG = _struct("DateTime string, EdgeLocation string, Bytes bigint, IP string, Operation string, Domain string, Object string, HTTPResponse string, UserAgent string, ts timestamp")
WIKI_STAT = _struct("projectcode string, pagename string, pageviews int, pagesize int")
RATING = _struct("user string, item string, rating bigint")
ITEM_NAME = _struct("item string, name string")
SEQUENCE = _struct("seq_id bigint, chunk bigint, offset bigint, last_chunk boolean, seq string")
ALIGNMENT = _struct("read_id bigint, ref_id bigint, ref_start int, ref_end int, differences int, is_rc boolean")
_AUTHOR = _struct("id string, avatar string, link string, name string, username string")
INTERACTION = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("author", _AUTHOR), T.StructField("content", T.StringType()), T.StructField("created_at", T.StringType()),
    T.StructField("link", T.StringType()), T.StructField("schema", _struct("version string")), T.StructField("source", T.StringType()),
])
ACTIVITY_DOCUMENT = T.StructType([T.StructField("id", T.StringType()), T.StructField("hash", T.StringType()), T.StructField("interactions", T.ArrayType(T.StructType([T.StructField("interaction", INTERACTION)])))])
