"""Queries of the general numbered problems 1, 2, 3 and 5, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import begin_ms, hour_name, present, trimmed
from ..operators import badrows, late, orphans, sessions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    parents, removals = table(spark, d, "impressions"), table(spark, d, "impression_removals")
    refs = orphans.timed_references(table(spark, d, "clicks"), "clicks").unionByName(orphans.lasting_references(table(spark, d, "joined_impressions"), "joined_impressions"))
    return orphans.orphan_references(refs, orphans.parent_states(parents, removals), parents.count() + removals.count())


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("src", F.col("id").alias("impression_id"), "period")


def p1_orphans_by_period(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans_by_period(_orphans(spark, d))


def _faults(spark: SparkSession, d: str) -> DataFrame:
    raw = badrows.rejected(badrows.parse_access_lines(table(spark, d, "raw_logs"))).select(F.lit("raw_logs").alias("src"), "row_id", "reason")
    return raw.unionByName(badrows.rejected_loaded(table(spark, d, "logs_base")).select(F.lit("logs_base").alias("src"), "row_id", "reason"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _faults(spark, d).select("src", "row_id")


def p2_rejects_by_reason(spark: SparkSession, d: str) -> DataFrame:
    return _faults(spark, d).groupBy("src", "reason").agg(F.count(F.lit(1)).alias("n_rows"))


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    return badrows.loaded(badrows.parse_access_lines(table(spark, d, "raw_logs")))


def _released(spark: SparkSession, d: str, published: bool) -> DataFrame:
    ids = late.id_arrivals(table(spark, d, "impressions"), table(spark, d, "clicks"))
    events = late.deliveries(ids)
    if published:
        events = events.unionByName(late.stale_publications(table(spark, d, "joined_impressions"), ids))
    return late.k_slack(events)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return late.corrections(_released(spark, d, True)).select("src", F.col("id").alias("impression_id"), hour_name(F.col("evhour")).alias("evhour"))


def p3_hourly_figures(spark: SparkSession, d: str) -> DataFrame:
    return late.hourly_figures(_released(spark, d, False))


def p3_running_figures(spark: SparkSession, d: str) -> DataFrame:
    return late.running_figures(_released(spark, d, False))


def _visits(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessions(table(spark, d, "impressions"), present(trimmed(F.col("userCookie"))), begin_ms(F.col("requestBeginTime")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _visits(spark, d).select(F.col("key").alias("userCookie"), "start_ms", "end_ms")


def p5_visits(spark: SparkSession, d: str) -> DataFrame:
    return _visits(spark, d).withColumnRenamed("key", "userCookie")


QUERIES = {f.__name__: f for f in (p1_found, p1_orphans_by_period, p2_found, p2_rejects_by_reason, p2_loaded, p3_found, p3_hourly_figures, p3_running_figures, p5_found, p5_visits)}

_ID = r"nullif(nullif(lower(trim({0}, ' \t')), ''), '-')".replace(r"\t", "' || chr(9) || '")
_CLICK_ORPHAN = f"""
  SELECT 'clicks' AS src, c.id, c.dt AS period,
    CASE WHEN p.id IS NULL THEN 'missing' WHEN r.removed_dt <= c.dt THEN 'withdrawn' ELSE 'later' END AS reason, n
  FROM (SELECT {_ID.format('impressionId')} AS id, dt, count(*) AS n FROM clicks GROUP BY 1, 2) c
  LEFT JOIN (SELECT {_ID.format('impressionId')} AS id, min(dt) AS first_dt FROM impressions GROUP BY 1) p ON p.id = c.id
  LEFT JOIN (SELECT {_ID.format('impressionId')} AS id, min(dt) AS removed_dt FROM impression_removals GROUP BY 1) r ON r.id = c.id
  WHERE c.id IS NOT NULL AND (NOT coalesce(p.first_dt <= c.dt, false) OR coalesce(r.removed_dt <= c.dt, false))"""
_JOINED_ORPHAN = f"""
  SELECT 'joined_impressions' AS src, j.id, j.period, CASE WHEN p.id IS NULL THEN 'missing' ELSE 'withdrawn' END AS reason, n
  FROM (SELECT {_ID.format('impressionId')} AS id, day || '-' || hour AS period, count(*) AS n FROM joined_impressions GROUP BY 1, 2) j
  LEFT JOIN (SELECT DISTINCT {_ID.format('impressionId')} AS id FROM impressions) p ON p.id = j.id
  LEFT JOIN (SELECT DISTINCT {_ID.format('impressionId')} AS id FROM impression_removals) r ON r.id = j.id
  WHERE j.id IS NOT NULL AND (p.id IS NULL OR r.id IS NOT NULL)"""
_LINE = "regexp_replace(line, '[ \\t\\r]+$', '')"
_Q = r'"(?:[^"\\]|\\.)*"'
_STAMP = r"[0-9]{2}/(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)/[0-9]{4}:[0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4}"
_SHAPE = rf'([^ \t\r\n\f\v]+) ([^ \t\r\n\f\v]+) ([^ \t\r\n\f\v]+) \[({_STAMP})\] "((?:[^"\\]|\\.)+)" ([1-5][0-9][0-9]) (-|[0-9]+) "((?:[^"\\]|\\.)*)" "((?:[^"\\]|\\.)*)"'
_RAW = f"""
  SELECT line_no, {_LINE} AS line, line IS NOT NULL AND strpos(line, chr(10)) = 0 AND regexp_full_match({_LINE}, '{_SHAPE}', 's')
    AND try_strptime(regexp_extract({_LINE}, '\\[([^ ]*) [+-][0-9]{{4}}\\]', 1), '%d/%b/%Y:%H:%M:%S') IS NOT NULL
    AND coalesce(try_cast(coalesce(nullif(regexp_extract({_LINE}, '" [0-9]+ ([0-9]+) "', 1), ''), '0') AS HUGEINT) <= 9223372036854775807, false) AS ok
  FROM raw_logs"""
_BASE_OK = """status IS NOT NULL AND status BETWEEN 100 AND 599 AND bytes_string IS NOT NULL
    AND (bytes_string = '-' OR regexp_full_match(bytes_string, '[0-9]+') AND coalesce(try_cast(bytes_string AS HUGEINT) <= 9223372036854775807, false))"""
_P2 = f"""
  SELECT 'raw_logs' AS src, line_no AS row_id FROM ({_RAW}) WHERE NOT coalesce(ok, false)
  UNION ALL SELECT 'logs_base', log_id FROM logs_base WHERE NOT ({_BASE_OK})"""
# The first reason in the order of parsing. The quoted rest must read as fields of csv: quoted, or bare without a leading quote.
_BARE = r'[^ \t\r\n\f\v]+'
_CSV = r'"(?:[^"\\]|\\.|"")*"|(?:[^" \\\r]|\\.)(?:[^ \\\r]|\\.)*|'
_PLAIN = r"regexp_replace(CASE WHEN {0}[1] = '\"' THEN replace({0}[2:-2], '\"\"', '\"') ELSE {0} END, '\\(.)', '\1', 'gs')".replace('\\"', '"')
_REASONS = f"""
  SELECT CASE WHEN line IS NULL THEN 'null_line' WHEN strpos(line, chr(10)) > 0 THEN 'embedded_newline'
    WHEN NOT regexp_matches(l, '^[^ ]* [^ ]* [^ ]* ') THEN 'field_count' WHEN NOT regexp_matches(l, '^{_BARE} {_BARE} {_BARE} ') THEN 'spacing'
    WHEN strpos(t, ']') = 0 OR t[1] <> '[' THEN 'bad_time' WHEN r[1] <> ' ' OR r = '' THEN 'spacing'
    WHEN NOT regexp_full_match(r[2:], '(?:{_CSV})(?: (?:{_CSV}))*', 's') THEN 'quoting' WHEN NOT regexp_full_match(r[2:], '(?:{_CSV})(?: (?:{_CSV})){{4}}', 's') THEN 'field_count'
    WHEN NOT regexp_full_match(t[2:strpos(t, ']') - 1], '{_STAMP}') OR try_strptime(t[2:21], '%d/%b/%Y:%H:%M:%S') IS NULL THEN 'bad_time'
    WHEN f[1] = '' THEN 'empty_request' WHEN NOT regexp_full_match(f[2], '[1-5][0-9][0-9]') THEN 'bad_status'
    WHEN f[3] <> '-' AND NOT (regexp_full_match(f[3], '[0-9]+') AND coalesce(try_cast(f[3] AS HUGEINT) <= 9223372036854775807, false)) THEN 'bad_bytes' WHEN NOT coalesce(ok, false) THEN 'layout' END AS reason
  FROM (SELECT *, list_transform(range(1, 6), lambda i: {_PLAIN.format('g[i]')}) AS f FROM (SELECT *, list_value({', '.join(f"regexp_extract(r[2:], '^({_CSV}) ({_CSV}) ({_CSV}) ({_CSV}) ({_CSV})$', {i}, 's')" for i in range(1, 6))}) AS g
    FROM (SELECT *, t[strpos(t, ']') + 1:] AS r FROM (SELECT *, regexp_replace(l, '^[^ ]* [^ ]* [^ ]* ', '') AS t FROM (SELECT raw_logs.line, w.line AS l, w.ok FROM raw_logs JOIN ({_RAW}) w USING (line_no))))))"""
_FIRSTS = f"""
  imp AS (SELECT {_ID.format('impressionId')} AS id, min(dt) AS dt,
      min(CASE WHEN regexp_full_match(trim(requestBeginTime, ' ' || chr(9)), '[0-9]{{13}}') THEN trim(requestBeginTime, ' ' || chr(9))::BIGINT // 3600000 END) AS h
    FROM impressions WHERE {_ID.format('impressionId')} IS NOT NULL GROUP BY 1),
  clk AS (SELECT {_ID.format('impressionId')} AS id, min(dt) AS dt FROM clicks WHERE {_ID.format('impressionId')} IS NOT NULL GROUP BY 1),
  ev AS (SELECT 'impressions' AS src, id, h, epoch(strptime(dt, '%Y-%m-%d-%H-%M'))::BIGINT // 60 AS arr FROM imp WHERE h IS NOT NULL
    UNION ALL SELECT 'clicks', id, h, epoch(strptime(clk.dt, '%Y-%m-%d-%H-%M'))::BIGINT // 60 FROM imp JOIN clk USING (id) WHERE h IS NOT NULL)"""
_HOUR = "strftime(make_timestamp(h * 3600000000), '%Y-%m-%d-%H')"
_VISITS = """
  SELECT k AS "userCookie", min(ms) AS start_ms, max(ms) AS end_ms, max(ms) - min(ms) AS duration_ms, count(*) AS n_events FROM (
    SELECT k, ms, sum(fresh) OVER (PARTITION BY k ORDER BY ms ROWS UNBOUNDED PRECEDING) AS v FROM (
      SELECT k, ms, CASE WHEN ms - lag(ms) OVER (PARTITION BY k ORDER BY ms) <= 1800000 THEN 0 ELSE 1 END AS fresh FROM (
        SELECT trim("userCookie", ' ' || chr(9)) AS k, trim("requestBeginTime", ' ' || chr(9))::BIGINT AS ms FROM impressions
        WHERE regexp_full_match(trim("requestBeginTime", ' ' || chr(9)), '[0-9]{13}') AND trim("userCookie", ' ' || chr(9)) NOT IN ('', '-')))) GROUP BY k, v"""

ORACLE = {
    "p1_found": f"SELECT src, id AS impression_id, period FROM ({_CLICK_ORPHAN} UNION ALL {_JOINED_ORPHAN})",
    "p1_orphans_by_period": f"SELECT src, period, reason, count(*) AS n_ids, sum(n)::BIGINT AS n_refs FROM ({_CLICK_ORPHAN} UNION ALL {_JOINED_ORPHAN}) GROUP BY 1, 2, 3",
    "p2_found": _P2,
    "p2_rejects_by_reason": f"""SELECT 'raw_logs' AS src, reason, count(*) AS n_rows FROM ({_REASONS}) WHERE reason IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'logs_base', CASE WHEN coalesce(status BETWEEN 100 AND 599, false) THEN 'bad_bytes' ELSE 'bad_status' END, count(*) FROM logs_base WHERE NOT ({_BASE_OK}) GROUP BY 2""",
    "p2_loaded": f"""
      SELECT line_no AS row_id, g[1] AS "remoteAddr", g[2] AS "remoteLogname", g[3] AS "user", g[4] AS time, regexp_replace(g[5], '\\\\(.)', '\\1', 'gs') AS request,
        g[6]::INTEGER AS status, g[7] AS bytes_string, regexp_replace(g[8], '\\\\(.)', '\\1', 'gs') AS referrer, regexp_replace(g[9], '\\\\(.)', '\\1', 'gs') AS browser,
        strptime(g[4][:20], '%d/%b/%Y:%H:%M:%S') - (CASE WHEN g[4][22] = '-' THEN -1 ELSE 1 END) * (g[4][23:24]::INTEGER * 60 + g[4][25:26]::INTEGER) * INTERVAL 1 MINUTE AS dtime,
        CASE WHEN g[7] = '-' THEN 0 ELSE g[7]::BIGINT END AS bytes
      FROM (SELECT line_no, list_value({', '.join(f"regexp_extract(line, '{_SHAPE}', {i}, 's')" for i in range(1, 10))}) AS g FROM ({_RAW}) WHERE ok)""",
    "p3_found": f"""WITH {_FIRSTS},
      jn AS (SELECT DISTINCT 'joined_impressions' AS src, {_ID.format('impressionId')} AS id, epoch(strptime(day || '-' || hour, '%Y-%m-%d-%H'))::BIGINT // 3600 AS h
        FROM joined_impressions WHERE clicked IS NOT TRUE)
      SELECT src, id AS impression_id, {_HOUR} AS evhour FROM ev WHERE arr >= h * 60 + 80 AND arr < h * 60 + 1500
      UNION ALL SELECT src, id, {_HOUR} FROM (SELECT jn.*, epoch(strptime(clk.dt, '%Y-%m-%d-%H-%M'))::BIGINT // 60 AS arr FROM jn JOIN clk USING (id)) WHERE arr < h * 60 + 1500""",
    "p3_hourly_figures": f"""WITH {_FIRSTS} SELECT {_HOUR} AS evhour, {', '.join(
        f"(count(*) FILTER (src = '{s}' AND {w}))::BIGINT AS {s}_{k}" for s in ('impressions', 'clicks') for k, w in (('provisional', 'arr < h * 60 + 80'), ('final', 'arr < h * 60 + 1500'), ('dropped', 'arr >= h * 60 + 1500')))}
      FROM ev GROUP BY h""",
    "p3_running_figures": f"""WITH {_FIRSTS} SELECT {_HOUR} AS evhour, strftime(make_timestamp(arr * 60000000), '%Y-%m-%d %H:%M') AS arrival,
        impressions::BIGINT AS impressions, clicks::BIGINT AS clicks, clicks / nullif(impressions, 0)::DOUBLE AS click_rate
      FROM (SELECT h, arr, sum(i) OVER w AS impressions, sum(c) OVER w AS clicks
        FROM (SELECT h, arr, count(*) FILTER (src = 'impressions') AS i, count(*) FILTER (src = 'clicks') AS c FROM ev WHERE arr < h * 60 + 1500 GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY h ORDER BY arr ROWS UNBOUNDED PRECEDING))""",
    "p5_found": f'SELECT "userCookie", start_ms, end_ms FROM ({_VISITS})',
    "p5_visits": _VISITS,
}
