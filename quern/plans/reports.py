"""Queries of the report, ads, similarity, alignment and keyed-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import logs as L
from ..functions.dna import BASES, pack_seed, reverse_complement, unpack_seed
from ..functions.ids import clean_id
from ..functions.times import partition_window
from ..operators import ads, alignment, counting, keyed, log_reports, related
from ..scratch import Scratch
from ..streaming import volumes

N_USERS, MIN_CORATINGS, K_RELATED = 147160, 5, 25
READ_LEN, K_DIFFS, KMER = 32, 1, 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


# Counts and top lists


@query("SELECT l_partkey, sum(l_quantity) AS sum_qty FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_keys_by_sum(spark: SparkSession, d: str) -> DataFrame:
    return counting.top(table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("sum_qty")), "sum_qty", 10, "l_partkey")


@query("""SELECT count(*) AS views, regexp_extract(request, '^[^ ]+ ([^ ]+)', 1) AS page FROM logs_base
  WHERE regexp_matches(request, '^[^ ]+ ([^ ]+)') GROUP BY 2 ORDER BY 1 DESC, 2 LIMIT 50""")
def top50_pages(spark: SparkSession, d: str) -> DataFrame:
    page = F.regexp_extract("request", r"^[^ ]+ ([^ ]+)", 1)
    rows = table(spark, d, "logs_base").where(F.col("request").rlike(r"^[^ ]+ ([^ ]+)"))
    return counting.top(rows.groupBy(page.alias("page")).agg(F.count(F.lit(1)).alias("views")), "views", 50, "page").select("views", "page")


@query("SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9]*')) AS w FROM documents) GROUP BY 1")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return counting.word_count(table(spark, d, "documents"), "text")


_TOKENS = "(SELECT unnest(regexp_split_to_array(text, '[\\s,]+')) AS token FROM documents)"


@query(f"SELECT token, count(*) AS n FROM {_TOKENS} WHERE starts_with(token, 'a/') GROUP BY 1")
def token_prefix_count(spark: SparkSession, d: str) -> DataFrame:
    return counting.token_count(table(spark, d, "documents"), "text", "a/")


@query(f"SELECT token, count(*) AS n FROM {_TOKENS} WHERE contains(token, '/cache/') GROUP BY 1")
def token_contains_count(spark: SparkSession, d: str) -> DataFrame:
    return counting.token_count(table(spark, d, "documents"), "text", "/cache/", anywhere=True)


# Access and CDN logs


def _access(spark: SparkSession, d: str) -> DataFrame:
    """Lines loaded earlier together with the raw lines, parsed by layout."""
    raw = L.parse_access(table(spark, d, "raw_logs"))
    base = L.typed_access(table(spark, d, "logs_base").select(*L.ACCESS_FIELDS))
    return raw.unionByName(base)


_LINE = r"""'^(\S+) (\S+) (\S+) \[([\w:/]+\s[+\-]\d{4})\] "(.+?)" (\S+) (\S+) "([^"]*)" "([^"]*)"'"""
_WHOLE = lambda c: f"CASE WHEN regexp_full_match({c}, '[+-]?[0-9]+') THEN try_cast({c} AS BIGINT) END"
_ACCESS = f"""(SELECT *, CASE WHEN regexp_full_match(replace(bytes_string, '-', '0'), '[0-9]+') THEN try_cast(replace(bytes_string, '-', '0') AS BIGINT) END AS bytes,
    CASE WHEN regexp_full_match("time", '[0-9]{{2}}/[A-Za-z]{{3}}/[0-9]{{4}}:([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9] [+-][0-9]{{4}}')
      THEN try_strptime("time"[:20], '%d/%b/%Y:%H:%M:%S') - (CASE WHEN "time"[22] = '-' THEN -1 ELSE 1 END) * ("time"[23:24]::INTEGER * 60 + "time"[25:26]::INTEGER) * INTERVAL 1 MINUTE END AS dtime
  FROM (SELECT "remoteAddr", "time", request, status, bytes_string, referrer FROM logs_base UNION ALL
    SELECT {', '.join(f"regexp_extract(line, {_LINE}, {i}) AS {n}" if n != 'status' else f"{_WHOLE(f'regexp_extract(line, {_LINE}, 6)')}::INTEGER" for i, n in ((1, '"remoteAddr"'), (4, '"time"'), (5, 'request'), (6, 'status'), (7, 'bytes_string'), (8, 'referrer')))}
    FROM raw_logs WHERE regexp_matches(line, {_LINE})) WHERE "remoteAddr" IS NOT NULL)"""


@query(f"SELECT count(*) AS n_lines, count(*) - (count(*) FILTER (regexp_matches(line, {_LINE}))) AS bad_lines FROM raw_logs")
def access_bad_lines(spark: SparkSession, d: str) -> DataFrame:
    return log_reports.bad_lines(L.parse_access(table(spark, d, "raw_logs")))


def _as_text(df: DataFrame, *names: str) -> DataFrame:
    """Sums beyond a bigint as text, which compares exactly everywhere."""
    return df.withColumns({c: F.col(c).cast("string") for c in names if c in df.columns})


def _access_report(name: str):
    return lambda spark, d: _as_text(log_reports.access_log_reports(_access(spark, d))[name], "num_bytes")


QUERIES |= {
    "access_hourly_traffic": _access_report("total_requests_bytes_per_hour"),
    "access_top_blocks": _access_report("top_50_ips"),
    "access_top_referrers": _access_report("top_50_external_referrers"),
    "access_top_search_terms": _access_report("top_50_search_terms_from_bing_google"),
}
ORACLE |= {
    "access_hourly_traffic": f"SELECT strftime(dtime, '%H') AS hour, count(*) AS num_requests, sum(bytes)::HUGEINT::VARCHAR AS num_bytes FROM {_ACCESS} WHERE dtime IS NOT NULL GROUP BY 1",
    "access_top_blocks": f"""SELECT regexp_extract("remoteAddr", '(\\d+\\.\\d+\\.\\d+)', 1) || '.*' AS block, count(*) AS num_requests, sum(bytes)::HUGEINT::VARCHAR AS num_bytes
      FROM {_ACCESS} WHERE regexp_matches("remoteAddr", '\\d+\\.\\d+\\.\\d+') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""",
    "access_top_referrers": f"""SELECT host AS referrer, count(*) AS num_requests FROM (SELECT regexp_extract(referrer, '(http://[a-z0-9.-]+)', 1) AS host FROM {_ACCESS}
      WHERE regexp_matches(referrer, 'http://[a-z0-9.-]+')) WHERE NOT regexp_full_match(host, '.*example\\.org') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""",
    "access_top_search_terms": f"""SELECT regexp_extract(referrer, '.*[&?]q=([^&]+).*', 1) AS term, count(*) AS num FROM {_ACCESS}
      WHERE (referrer LIKE '%bing%' OR referrer LIKE '%google%') AND regexp_matches(referrer, '.*[&?]q=([^&]+).*') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""",
}

_CDN_OK = r"""regexp_full_match("time", '[0-9]{2}/(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)/[0-9]{4}:([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9] [+-][0-9]{4}') AND regexp_full_match("remoteAddr", '[^ \t]+')
    AND regexp_full_match(request, '[A-Z]+ [^ \t]+ [^ \t]+') AND status IS NOT NULL AND browser IS NOT NULL"""


MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def cdn_lines(base: DataFrame) -> DataFrame:
    """CDN-log lines written from loaded access-log rows of any date, a '#' header line before one in a thousand."""
    shape = F.col("time").rlike(rf"\A[0-9]{{2}}/({'|'.join(MONTHS)})/[0-9]{{4}}:([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9] [+-][0-9]{{4}}\z") & F.col("remoteAddr").rlike(r"\A[^ \t]+\z")
    ok = shape & F.col("request").rlike(r"\A[A-Z]+ [^ \t]+ [^ \t]+\z") & F.col("status").isNotNull() & F.col("browser").isNotNull()
    call = F.split("request", " ")
    month = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, f"{i:02}")))[F.substring("time", 4, 3)]
    date = F.concat_ws("-", F.substring("time", 8, 4), month, F.substring("time", 1, 2))
    size = F.when(F.col("bytes_string").rlike(r"\A[0-9]+\z"), F.col("bytes_string")).otherwise("0")
    fields = [date, F.substring("time", 13, 8), F.concat(F.lit("EDGE"), F.length("remoteAddr").cast("string")), size, F.col("remoteAddr"), call[0], F.lit("d1.example.net"), call[1], F.col("status").cast("string"), F.lit("-"), F.col("browser")]
    line = F.array_join(F.array(*fields), "\t")
    lines = F.when(F.pmod("log_id", F.lit(1000)) == 0, F.array(F.lit("#Version: 1.0"), line)).otherwise(F.array(line))
    return base.where(ok).select(F.explode(lines).alias("line"))


def _cdn_report(name: str):
    return lambda spark, d: _as_text(log_reports.cdn_reports(L.parse_cdn(cdn_lines(table(spark, d, "logs_base"))))[name], "TotalBytes")


_CDN = f"""(SELECT try_strptime("time"[:20], '%d/%b/%Y:%H:%M:%S') AS ts, 'EDGE' || length("remoteAddr") AS "EdgeLocation", CASE WHEN regexp_full_match(bytes_string, '[0-9]+') THEN try_cast(bytes_string AS BIGINT) ELSE 0 END AS "Bytes",
    "remoteAddr" AS "IP", split_part(request, ' ', 2) AS "Object", status::VARCHAR AS "HTTPResponse" FROM logs_base WHERE {_CDN_OK})"""
_BUCKET = "strftime(make_timestamp(epoch_us(ts) // 300000000 * 300000000), '%Y-%m-%d %H:%M:%S') AS \"BucketedDateTime\""
for _report, _field in log_reports.CDN_REPORTS.items():
    _key = f'"{_field}"' if _field else _BUCKET
    for _measure, _more, _what in (("request-count", "", 'count(*) AS "RequestCount"'), ("bytes-transferred", "", 'sum("Bytes")::HUGEINT::VARCHAR AS "TotalBytes"'), ("request-count-by-httpresponse", ', "HTTPResponse"', 'count(*) AS "RequestCount"')):
        _name = f"cdn_{_report}_{_measure}".replace("-", "_")
        QUERIES[_name] = _cdn_report(f"{_report}-{_measure}")
        ORACLE[_name] = f"SELECT {_key}{_more}, {_what} FROM {_CDN} {'' if _field else 'WHERE ts IS NOT NULL'} GROUP BY 1{', 2' if _more else ''}"


# Ads


def period(spark: SparkSession, d: str) -> tuple[str, str, str]:
    """Bounds around all partitions of impressions: midnight of the day before the first and after the last; and 20 minutes more."""
    day = lambda c, by: F.date_add(F.to_date(F.substring(c, 1, 10)), by)
    valid = table(spark, d, "impressions").where(F.try_to_timestamp("dt", F.lit("yyyy-MM-dd-HH-mm")).isNotNull())
    a, b = valid.agg(day(F.min("dt"), -1).cast("string"), day(F.max("dt"), 1).cast("string")).first()
    return f"{a}-00-00", f"{b}-00-00", f"{b}-00-20"


def _joined(spark: SparkSession, d: str, **how) -> DataFrame:
    return ads.click_join(table(spark, d, "impressions"), table(spark, d, "clicks"), *period(spark, d), **how)


_MS = "CASE WHEN regexp_full_match(trim(\"requestBeginTime\", ' ' || chr(9)), '[0-9]+') THEN strftime(make_timestamp(trim(\"requestBeginTime\", ' ' || chr(9))::BIGINT // 1000 * 1000000), '%Y-%m-%d %H:%M:%S') END AS \"requestBeginTime\""
_BOUND = "(SELECT strftime(strptime({0}(dt), '%Y-%m-%d-%H-%M') {1} INTERVAL 1 DAY, '%Y-%m-%d-00-') FROM impressions WHERE try_strptime(dt, '%Y-%m-%d-%H-%M') IS NOT NULL) || '{2}'"
_FROM, _TO, _LATE = _BOUND.format("min", "-", "00"), _BOUND.format("max", "+", "00"), _BOUND.format("max", "+", "20")
_JOIN = f"""(SELECT i.* EXCLUDE dt, c.id IS NOT NULL AS clicked FROM (SELECT {_MS}, "adId", "impressionId", referrer, "userAgent", "userCookie", ip, dt FROM impressions WHERE dt > {_FROM} AND dt < {_TO}) i
  LEFT JOIN (SELECT {{0}} "impressionId" AS id FROM clicks WHERE "impressionId" IS NOT NULL AND dt > {_FROM} AND dt < {_LATE}) c ON i."impressionId" = c.id)"""


@query(f"SELECT * FROM {_JOIN.replace('{0}', '')}")
def click_join(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d)


@query(f"SELECT clicked, count(*) AS n FROM {_JOIN.replace('{0}', 'DISTINCT')} GROUP BY 1")
def clicked_counts(spark: SparkSession, d: str) -> DataFrame:
    return ads.clicked_counts(_joined(spark, d, dedupe_clicks=True))


_FEATURE = """SELECT feature, ad_id, (count(*) FILTER (clicked))::DOUBLE / count(*) AS clicked_percent FROM (
    SELECT 'ua:' || trim(lower(t)) AS feature, ad_id, clicked FROM (SELECT unnest(regexp_split_to_array("userAgent", '[;/,() ]')) AS t, "adId" AS ad_id, clicked FROM joined_impressions) WHERE t <> ''
    UNION ALL SELECT 'ip:' || regexp_extract(ip, '^([0-9]{1,3}[.][0-9]{1,3}).*', 1), "adId", clicked FROM joined_impressions WHERE ip IS NOT NULL
    UNION ALL SELECT 'page:' || lower(referrer), "adId", clicked FROM joined_impressions WHERE referrer IS NOT NULL) GROUP BY 1, 2"""


@query(_FEATURE)
def ctr_feature_index(spark: SparkSession, d: str) -> DataFrame:
    return ads.feature_index(table(spark, d, "joined_impressions"))


@query("""SELECT coalesce(hostname, CASE WHEN grouping(hostname) = 1 THEN 'ALL' END) AS hostname, max("requestTime") AS tmax, min("requestTime") AS tmin, round(avg("requestTime"), 2) AS tavg
  FROM local_metrics WHERE isfinite("requestTime") GROUP BY GROUPING SETS ((), (hostname))""")
def response_stats(spark: SparkSession, d: str) -> DataFrame:
    return ads.response_stats(table(spark, d, "local_metrics")).withColumn("tavg", F.round("tavg", 2))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests whose end is some way after their begin, by the length of their agent."""
    end = (F.btrim("requestBeginTime", F.lit(" \t")).cast("bigint") + 13 * F.length("userAgent")).cast("string")
    rows = table(spark, d, "impressions").where(F.btrim("requestBeginTime", F.lit(" \t")).rlike(r"\A[0-9]{13}\z") & F.col("userAgent").isNotNull())
    return rows.select("requestBeginTime", end.alias("requestEndTime"), F.col("adId").alias("hostname"))


@query("""SELECT coalesce(h, CASE WHEN grouping(h) = 1 THEN 'ALL' END) AS hostname, max(t) AS tmax, min(t) AS tmin, round(avg(t), 6) AS tavg
  FROM (SELECT 13 * length("userAgent") / 1000.0::DOUBLE AS t, "adId" AS h FROM impressions WHERE regexp_full_match(trim("requestBeginTime", ' ' || chr(9)), '[0-9]{13}') AND "userAgent" IS NOT NULL)
  GROUP BY GROUPING SETS ((), (h))""")
def request_time_stats(spark: SparkSession, d: str) -> DataFrame:
    return ads.response_stats(ads.request_times(_requests(spark, d))).withColumn("tavg", F.round("tavg", 6))


@query("""SELECT hour, "name", count(*) AS n FROM (SELECT unnest([h, h, h, h, before]) AS hour, unnest(['open', 'closed', 'late', 'equal', 'late']) AS "name", unnest([m > 0, true, m > 0, m = 0, m < 20]) AS inside
    FROM (SELECT dt[:13] AS h, dt[15:16]::INTEGER AS m, strftime(try_strptime(dt, '%Y-%m-%d-%H-%M') - INTERVAL 1 HOUR, '%Y-%m-%d-%H') AS before FROM impressions WHERE try_strptime(dt, '%Y-%m-%d-%H-%M') IS NOT NULL)) WHERE inside GROUP BY 1, 2""")
def window_filters(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every hour's partitions under each of the four kinds of bounds."""
    at = F.try_to_timestamp("dt", F.lit("yyyy-MM-dd-HH-mm"))
    name = lambda t: F.date_format(t, "yyyy-MM-dd-HH-mm")
    hours = F.explode(F.array(*(F.date_trunc("hour", at) - F.expr(f"interval {k} hours") for k in (0, 1)))).alias("hour")
    rows = table(spark, d, "impressions").where(at.isNotNull()).select("dt", hours)
    dt, a, b, late = F.col("dt"), name(F.col("hour")), name(F.col("hour") + F.expr("interval 1 hour")), name(F.col("hour") + F.expr("interval 80 minutes"))
    kinds = {"open": partition_window(dt, a, b), "closed": partition_window(dt, a, b, True), "late": partition_window(dt, a, late), "equal": dt == a}
    each = F.explode(F.array(*(F.when(c, F.lit(k)) for k, c in kinds.items()))).alias("name")
    return rows.select(F.date_format("hour", "yyyy-MM-dd-HH").alias("hour"), each).where("name is not null").groupBy("hour", "name").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT {_MS}, "adId", "impressionId", referrer, "userAgent", "userCookie", ip FROM impressions
  WHERE dt >= {_FROM} AND dt < {_TO} AND referrer = 'http://www.elderbay.example/copper' AND "userAgent" LIKE '%Mozilla%'""")
def filtered_export(spark: SparkSession, d: str) -> DataFrame:
    return ads.filtered_impressions(table(spark, d, "impressions"), "http://www.elderbay.example/copper", "Mozilla", *period(spark, d)[:2])


# Similarity


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """Customers rate suppliers by the quantity they bought."""
    bought = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return bought.select(F.col("o_custkey").alias("user"), F.col("l_suppkey").alias("item"), F.col("l_quantity").cast("bigint").alias("rating"))


_RATINGS = "(SELECT o_custkey AS u, l_suppkey AS i, l_quantity::BIGINT AS r FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
_SCALED = f"(SELECT u, i::VARCHAR AS i, floor(ln(sum(r)))::BIGINT + 1 AS r FROM {_RATINGS} GROUP BY u, i)"
_PAIRS = f"""(SELECT item_x, item_y, n, CASE WHEN n < 4 THEN 0.0 ELSE (CASE WHEN lo * hi < 0 THEN least(abs(lo), abs(hi)) ELSE least(lo, hi) END) * pow(n / (n + 20.0::DOUBLE), 2) * ln(n) / ln({N_USERS}) END AS sim FROM (
  SELECT *, CASE WHEN p >= 0 AND l < 0 THEN 0.0 ELSE l END AS lo, h AS hi FROM (
    SELECT *, tanh(atanh(p) - 1.96 / sqrt(greatest(n - 3, 1))) AS l, tanh(atanh(p) + 1.96 / sqrt(greatest(n - 3, 1))) AS h FROM (
      SELECT item_x, item_y, n, greatest(-0.9999, least(0.9999, CASE WHEN v = 0 THEN 0.0 ELSE round((n * sxy - sx * sy) / v, 4) END)) AS p FROM (
        SELECT *, sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) AS v FROM (
          SELECT a.i AS item_x, b.i AS item_y, count(*) AS n, sum(a.r * a.r)::DOUBLE AS sxx, sum(a.r)::DOUBLE AS sx, sum(a.r * b.r)::DOUBLE AS sxy, sum(b.r)::DOUBLE AS sy, sum(b.r * b.r)::DOUBLE AS syy
          FROM {_SCALED} a JOIN {_SCALED} b ON a.u = b.u AND a.i < b.i GROUP BY 1, 2))))))"""


@query(f"SELECT i::VARCHAR AS item, count(*) AS item_count FROM {_RATINGS} GROUP BY 1")
def item_counts(spark: SparkSession, d: str) -> DataFrame:
    return related.item_counts(ratings(spark, d)).withColumn("item", F.col("item").cast("string"))


@query(f"SELECT u AS user_key, count(*) AS user_count FROM {_RATINGS} GROUP BY 1")
def user_counts(spark: SparkSession, d: str) -> DataFrame:
    return related.user_counts(ratings(spark, d)).withColumnRenamed("user", "user_key")


@query(f"SELECT u AS user_key, 0 AS block, count(*) AS n, sum(r)::BIGINT AS total, string_agg(i || ',' || r, ' ' ORDER BY i) AS postings FROM {_SCALED} GROUP BY 1")
def user_postings(spark: SparkSession, d: str) -> DataFrame:
    rows = related.user_postings(related.scaled(ratings(spark, d), "log", "sum"))
    text = F.array_join(F.transform("postings", lambda p: F.concat_ws(",", p["item"], p["rating"].cast("string"))), " ")
    return rows.select(F.col("user").alias("user_key"), "block", "n", "total", text.alias("postings"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return related.item_similarity(ratings(spark, d), scale="log", cutoff=None, n_users=N_USERS)


@query(f"SELECT item_x, item_y, n, round(sim, 6) AS sim FROM {_PAIRS}")
def item_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).withColumn("sim", F.round("sim", 6))


@query(f"""WITH p AS MATERIALIZED (SELECT * FROM {_PAIRS}), b AS (SELECT item_x, item_y, sim, n FROM p UNION ALL SELECT item_y, item_x, sim, n FROM p),
  k AS (SELECT item_x, item_y, round(sim, 4) AS sim, n FROM b WHERE n >= {MIN_CORATINGS} QUALIFY row_number() OVER (PARTITION BY item_x ORDER BY round(sim, 9) DESC, item_y) <= {K_RELATED})
  SELECT r.*, s_name AS name FROM (SELECT * FROM k UNION ALL SELECT DISTINCT item_x, item_x, 1.0, 0 FROM k) r LEFT JOIN supplier ON s_suppkey::VARCHAR = item_y""")
def related_items_topk(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("item"), F.col("s_name").alias("name"))
    pairs = _pairs(spark, d).withColumn("sim", F.round("sim", 9))  # ties are ties whatever the last bits say
    return related.related_items(pairs, names, min_coratings=MIN_CORATINGS, k=K_RELATED)


CUTOFF = 20
_REAL = f"(SELECT u, i::VARCHAR AS i, sum(r) AS r FROM {_RATINGS} GROUP BY u, i)"
_KEPT = f"""(SELECT u, i, r FROM (SELECT *, count(*) OVER (PARTITION BY u) AS nu, count(*) OVER (PARTITION BY i) AS ni FROM {_REAL})
  WHERE ('0x' || md5(concat_ws('|', u, i, '42'))[:15])::BIGINT::DOUBLE / 1152921504606846976 < greatest({CUTOFF}.0 / nu, {CUTOFF}.0 / ni))"""


@query(f"SELECT item_x, item_y, n, round(sim, 6) AS sim FROM {_PAIRS.replace(_SCALED, _KEPT)}")
def item_similarity_sampled(spark: SparkSession, d: str) -> DataFrame:
    """With a cutoff below the number of ratings of most users and items, which keeps a part of these by hash."""
    return related.item_similarity(ratings(spark, d), scale="real", cutoff=CUTOFF, n_users=N_USERS).withColumn("sim", F.round("sim", 6))


# Keyed data and activity


@query("""SELECT coalesce(c.id, n.id) AS id, c."count" AS "count", coalesce(n."name", 'empty') AS "name" FROM (SELECT (user_id * 11)::VARCHAR AS id, count(*) AS "count" FROM events GROUP BY 1) c
  FULL OUTER JOIN (SELECT c_custkey::VARCHAR AS id, min(c_name) AS "name" FROM customer GROUP BY 1) n ON c.id = n.id""")
def kv_merge(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy((F.col("user_id") * 11).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("count"))
    names = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    return keyed.kv_merge(counts, names)


def activity_documents(spark: SparkSession, d: str) -> DataFrame:
    """(json) of events written as nested documents."""
    author = F.struct(F.col("user_id").cast("string").alias("id"), F.lit("a\"b\n\t").alias("name"))
    created = F.concat(F.lit("Thu, "), F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    one = F.struct(F.struct(F.col("event_id").cast("string").alias("id"), author.alias("author"), F.col("props").alias("content"), created.alias("created_at")).alias("interaction"))
    return table(spark, d, "events").select(F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.lit("h").alias("hash"), F.array(one).alias("interactions"))).alias("json"))


@query("SELECT strftime(ts, '%d %b %Y') AS day, count(*) AS \"count\" FROM events GROUP BY 1")
def activity_posts_per_day(spark: SparkSession, d: str) -> DataFrame:
    """Events written as nested JSON documents, read back, flattened and counted."""
    return keyed.posts_per_day(keyed.interactions(activity_documents(spark, d)))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS sum_k FROM events GROUP BY 1")
def json_counts_per_day(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("sum_k"))


@query("SELECT make_timestamp(epoch_us(ts) // 300000000 * 300000000) AS bucket, count(*) AS n FROM events GROUP BY 1")
def stream_volume(spark: SparkSession, d: str) -> DataFrame:
    """The five-minute volume of events as a stream run to its end."""
    path = f"{d}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    root = Scratch(spark).root
    volumes.drain(volumes.volume_stream(stream, "ts"), f"{root}/volume", f"{root}/progress")
    return spark.read.parquet(f"{root}/volume").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


# Alignment


def _bases(c) -> DataFrame:
    return F.translate(F.md5(c), "0123456789abcdef", BASES * 4)


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """(id, ref_id, own, seq): each delivered impression's id spells 32 bases, its reference 32 more on either side."""
    ids = table(spark, d, "impressions").select(clean_id(F.col("impressionId")).alias("id")).where("id is not null").distinct()
    own = _bases(F.col("id"))
    return ids.select("id", F.conv(F.substring(F.md5("id"), 1, 15), 16, 10).cast("bigint").alias("ref_id"), own.alias("own"), F.concat(_bases(F.concat("id", F.lit("l"))), own, _bases(F.concat("id", F.lit("r")))).alias("seq"))


def reads(spark: SparkSession, d: str) -> DataFrame:
    """(read_id, seq): each clicked id's bases with one of them changed, every other one from the other strand."""
    ids = table(spark, d, "clicks").select(clean_id(F.col("impressionId")).alias("id")).where("id is not null").distinct()
    rows = ids.select(F.conv(F.substring(F.md5("id"), 1, 15), 16, 10).cast("bigint").alias("read_id"), _bases(F.col("id")).alias("own"))
    at = F.pmod("read_id", F.lit(READ_LEN)).cast("int")
    changed = F.overlay("own", F.translate(F.substr("own", at + 1, F.lit(1)), BASES, "CGTA"), at + 1, F.lit(1))
    return rows.select("read_id", F.when(F.pmod("read_id", F.lit(2)) == 0, reverse_complement(changed)).otherwise(changed).alias("seq"))


def _aligned(spark: SparkSession, d: str, **how) -> DataFrame:
    return alignment.align(sequences(spark, d).select("ref_id", "seq"), reads(spark, d), k=K_DIFFS, read_len=READ_LEN, **how)


_B = "translate(md5({0}), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_CLEAN = "nullif(nullif(lower(trim(\"impressionId\", ' ' || chr(9))), ''), '-')"
_REFS = f"(SELECT ('0x' || md5(id)[:15])::BIGINT AS ref_id, {_B.format('id || chr(108)')} || {_B.format('id')} || {_B.format('id || chr(114)')} AS s FROM (SELECT DISTINCT {_CLEAN} AS id FROM impressions) WHERE id IS NOT NULL)"
_READS = f"""(SELECT read_id, CASE WHEN read_id % 2 = 0 THEN translate(reverse(c), 'ACGT', 'TGCA') ELSE c END AS q FROM (
  SELECT read_id, own[:p] || translate(own[p + 1:p + 1], 'ACGT', 'CGTA') || own[p + 2:] AS c FROM (SELECT read_id, own, (read_id % {READ_LEN})::INTEGER AS p FROM (
    SELECT ('0x' || md5(id)[:15])::BIGINT AS read_id, {_B.format('id')} AS own FROM (SELECT DISTINCT {_CLEAN} AS id FROM clicks) WHERE id IS NOT NULL))))"""
_ALIGNED = f"""(SELECT * FROM (SELECT read_id, ref_id, start AS ref_start, start + {READ_LEN} AS ref_end, len(list_filter(range(1, {READ_LEN + 1}), lambda p: s[start + p] <> q[p]))::INTEGER AS differences, is_rc FROM (
  SELECT DISTINCT r.ref_id, r.s, e.read_id, e.q, e.is_rc, (r.at0 - e.i)::INTEGER AS start FROM (SELECT ref_id, s, unnest(range(0, {3 * READ_LEN - 15})) AS at0, s[at0 + 1:at0 + 16] AS seed FROM {_REFS}) r
  JOIN (SELECT read_id, q, is_rc, unnest([0, 16]) AS i, q[i + 1:i + 16] AS seed FROM (SELECT read_id, q, false AS is_rc FROM {_READS} UNION ALL SELECT read_id, translate(reverse(q), 'ACGT', 'TGCA'), true FROM {_READS})) e ON r.seed = e.seed)
  WHERE start >= 0 AND start + {READ_LEN} <= {3 * READ_LEN}) WHERE differences <= {K_DIFFS})"""
_BEST = f"(SELECT * FROM {_ALIGNED} QUALIFY rank() OVER (PARTITION BY read_id ORDER BY differences) = 1 AND count(*) OVER (PARTITION BY read_id, differences) = 1)"


@query(f"SELECT * FROM {_ALIGNED}")
def align_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d)


@query(f"SELECT * FROM {_BEST}")
def align_unique_best(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d, unique=True, redundancy=2)


@query(f"SELECT count(*) AS n_alignments, count(*) FILTER (is_rc) AS n_reverse, count(DISTINCT read_id) AS n_reads FROM {_ALIGNED}")
def align_stats(spark: SparkSession, d: str) -> DataFrame:
    return alignment.alignment_stats(_aligned(spark, d))


def edited_reads(spark: SparkSession, d: str) -> DataFrame:
    """(read_id, seq): as :func:`reads`, but one base is changed, missing or added, by the id; the read keeps its length."""
    ids = table(spark, d, "clicks").select(clean_id(F.col("impressionId")).alias("id")).where("id is not null").distinct()
    rows = ids.select(F.conv(F.substring(F.md5("id"), 1, 15), 16, 10).cast("bigint").alias("read_id"), _bases(F.col("id")).alias("own"), _bases(F.concat("id", F.lit("r"))).alias("next"))
    at = F.pmod("read_id", F.lit(READ_LEN)).cast("int")
    before, here, after = F.substr("own", F.lit(1), at), F.substr("own", at + 1, F.lit(1)), F.substr("own", at + 2, F.lit(READ_LEN))
    other = F.translate(here, BASES, "CGTA")
    kind = F.pmod("read_id", F.lit(3))
    edited = F.when(kind == 0, F.concat(before, other, after)).when(kind == 1, F.concat(before, after, F.substring("next", 1, 1))).otherwise(F.substring(F.concat(before, other, here, after), 1, READ_LEN))
    return rows.select("read_id", F.when(F.pmod("read_id", F.lit(2)) == 0, reverse_complement(edited)).otherwise(edited).alias("seq"))


_EDITED = f"""(SELECT read_id, CASE WHEN read_id % 2 = 0 THEN translate(reverse(c), 'ACGT', 'TGCA') ELSE c END AS q FROM (
  SELECT read_id, CASE read_id % 3 WHEN 0 THEN own[:p] || o || own[p + 2:] WHEN 1 THEN own[:p] || own[p + 2:] || nxt[1:1] ELSE (own[:p] || o || own[p + 1:])[:{READ_LEN}] END AS c FROM (SELECT *, translate(own[p + 1:p + 1], 'ACGT', 'CGTA') AS o FROM (
    SELECT read_id, own, nxt, (read_id % {READ_LEN})::INTEGER AS p FROM (SELECT ('0x' || md5(id)[:15])::BIGINT AS read_id, {_B.format('id')} AS own, {_B.format('id || chr(114)')} AS nxt FROM (SELECT DISTINCT {_CLEAN} AS id FROM clicks) WHERE id IS NOT NULL)))))"""
# Each seed match with its flanks aligned on their own: of the reference lengths one apart at most, those with fewest edits, the shortest
# of them; the second seed counts only if the first one is edited, which a missing base right between the two is not.
_SEEDED = f"""(SELECT r.ref_id, r.s, e.read_id, e.is_rc, r.a, e.i, e.q[:e.i] AS ql, e.q[e.i + 17:] AS qr FROM (SELECT ref_id, s, unnest(range(0, {3 * READ_LEN - 15})) AS a, s[a + 1:a + 16] AS seed FROM {_REFS}) r
  JOIN (SELECT read_id, q, is_rc, unnest([0, 16]) AS i, q[i + 1:i + 16] AS seed FROM (SELECT read_id, q, false AS is_rc FROM {_EDITED} UNION ALL SELECT read_id, translate(reverse(q), 'ACGT', 'TGCA'), true FROM {_EDITED})) e ON r.seed = e.seed)"""
_KDIFF = f"""SELECT read_id, ref_id, (a - nl)::INTEGER AS ref_start, (a + 16 + nr)::INTEGER AS ref_end, min(el + er)::INTEGER AS differences, is_rc FROM (
  SELECT *, row_number() OVER (PARTITION BY read_id, ref_id, is_rc, a, i ORDER BY el, nl, er, nr) AS best FROM (
    SELECT *, CASE WHEN i = 0 THEN 0 ELSE levenshtein(s[a - nl + 1:a], ql) END AS el, CASE WHEN i = 16 THEN 0 ELSE levenshtein(s[a + 17:a + 16 + nr], qr) END AS er FROM (
      SELECT *, unnest(CASE WHEN i = 0 THEN [0] ELSE [15, 16, 17] END) AS nl FROM (SELECT *, unnest(CASE WHEN i = 16 THEN [0] ELSE [15, 16, 17] END) AS nr FROM {_SEEDED}))
    WHERE a >= nl AND a + 16 + nr <= length(s)))
  WHERE best = 1 AND el + er <= {K_DIFFS} AND (i = 0 OR el > 0 AND s[a - 16:a - 1] <> ql) GROUP BY ALL"""


@query(_KDIFF)
def align_kdifference(spark: SparkSession, d: str) -> DataFrame:
    return alignment.align(sequences(spark, d).select("ref_id", "seq"), edited_reads(spark, d), k=K_DIFFS, read_len=READ_LEN, mode="difference")


_KMERS = f"(SELECT unnest(range(1, {3 * READ_LEN - KMER + 2})) AS p, s[p:p + {KMER - 1}] AS kmer FROM {_REFS})"


@query(f"SELECT kmer, count(*) AS n FROM {_KMERS} GROUP BY 1")
def kmer_count(spark: SparkSession, d: str) -> DataFrame:
    return alignment.kmer_count(sequences(spark, d).select(F.col("ref_id").alias("seq_id"), "seq"), KMER)


@query(f"""SELECT kmer, ref_id AS seq_id, 0::BIGINT AS chunk, string_agg(p - 1, ' ' ORDER BY p) AS positions FROM (SELECT ref_id, unnest(range(1, {3 * READ_LEN - KMER + 2})) AS p, s[p:p + {KMER - 1}] AS kmer FROM {_REFS})
  GROUP BY 1, 2 HAVING count(*) > 1""")
def kmer_repeats(spark: SparkSession, d: str) -> DataFrame:
    """The places of the k-mers that a sequence holds more than once."""
    places = alignment.kmer_places(sequences(spark, d).select(F.col("ref_id").alias("seq_id"), "seq"), KMER).where(F.size("positions") > 1)
    return places.withColumn("positions", F.array_join("positions", " "))


@query(f"SELECT count(DISTINCT kmer) AS n_kmers, count(*)::BIGINT AS n_places FROM {_KMERS}")
def kmer_distinct(spark: SparkSession, d: str) -> DataFrame:
    return alignment.kmer_distinct(kmer_count(spark, d))


@query(f"SELECT min(length(s))::INTEGER AS min_len, max(length(s))::INTEGER AS max_len FROM {_REFS}")
def sequence_lengths(spark: SparkSession, d: str) -> DataFrame:
    return alignment.length_range(sequences(spark, d))


@query(f"""SELECT ref_id, list_reduce(list_transform(range(1, {READ_LEN // 2 + 1}), lambda i: (strpos('ACGT', s[i]) - 1)::BIGINT), lambda a, b: a * 4 + b) AS packed, s[:{READ_LEN // 2}] AS seed FROM {_REFS}""")
def packed_seeds(spark: SparkSession, d: str) -> DataFrame:
    """The first seed of every sequence as a number, and spelled from it again."""
    rows = sequences(spark, d).select("ref_id", pack_seed(F.substring("seq", 1, READ_LEN // 2)).alias("packed"))
    return rows.withColumn("seed", unpack_seed(F.col("packed"), READ_LEN // 2))
