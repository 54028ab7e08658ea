"""Queries of the problems tagged llm, over whole tables, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import present, trimmed
from ..scratch import Scratch
from . import digests, distinct, heavy, mixing, mojibake, packing, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "local_metrics").select("hostname", "dt", F.col("requestTime").alias("value")).where("hostname is not null and dt is not null")


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per hostname and day, each quantile with its certified rank error."""
    return digests.certified_percentiles(_times(spark, d), ["hostname", "dt"])


def p4_host_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per hostname over all days, from the merged digests of the days."""
    values = _times(spark, d)
    daily = Scratch(spark).write(digests.build_digests(values, ["hostname", "dt"]), "daily")
    merged = digests.merge_digests(daily, ["hostname"])
    return digests.certified(values, digests.estimates(merged, ["hostname"]), ["hostname"])


def _within(found: DataFrame, *keys: str) -> DataFrame:
    """Rows of each key and whether every quantile is within the stated rank error, a row at least being one rank."""
    ok = F.col("rank_error") <= F.greatest(F.lit(digests.STATED_RANK_ERROR), 1 / F.col("n"))
    return found.groupBy(*keys).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("n_quantiles"), F.every(ok).alias("within"))


def p4_within_stated_error(spark: SparkSession, d: str) -> DataFrame:
    return _within(p4_percentiles(spark, d), "hostname", "dt").drop("n_quantiles")


def p4_hosts_within_stated_error(spark: SparkSession, d: str) -> DataFrame:
    return _within(p4_host_percentiles(spark, d), "hostname")


_IDENTS = ("userCookie", "ip")


def _names(spark: SparkSession, d: str) -> DataFrame:
    name = lambda c: present(trimmed(F.col(c))).alias(c)
    return table(spark, d, "impressions").select(F.substring("dt", 1, 10).alias("day"), *map(name, ("userCookie", "ip", "adId", "referrer")))


def _levels(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    """Membership tables of userCookie and ip per ad and referrer, per ad and over all, and of adId over all."""
    rows = _names(spark, d)
    levels = distinct.memberships(rows, {c: F.col(c) for c in _IDENTS}, [F.col("adId"), F.col("referrer")], F.col("day"), {"adId": F.col("adId")})
    return [*zip(("ad_referrer", "ad", "day"), levels)]


def _named(df: DataFrame, per: str, period: str | None) -> DataFrame:
    field = F.array(*map(F.lit, (*_IDENTS, "adId")))[F.col("field")].alias("field")
    null = F.lit(None).cast("string")
    key = lambda k: F.col(k) if k in df.columns else null
    return df.select(field, F.lit(per).alias("per"), *([key("period").alias(period)] if period else []), key("k1").alias("adId"), key("k2").alias("referrer"), "n_distinct")


def p6_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct userCookie and ip per day, ad, and ad and referrer, and adId per day; exact (error 0)."""
    out = [_named(distinct.distinct_by_period(distinct.pattern_totals(m)) if per == "day" else distinct.distinct_in_all(m), per, "day") for per, m in _levels(spark, d)]
    return reduce(DataFrame.unionByName, out).withColumn("error", F.lit(0.0))


def p6_weeks(spark: SparkSession, d: str) -> DataFrame:
    """The same counts over the days of each week from Monday on, from pattern totals."""
    monday = lambda day: F.date_trunc("week", day).cast("date")
    out = [_named(distinct.distinct_by_period(distinct.pattern_totals(m), monday), per, "week") for per, m in _levels(spark, d)]
    return reduce(DataFrame.unionByName, out)


def _ad_patterns(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _names(spark, d).select(F.col("userCookie").alias("cookie"), F.col("adId").alias("ad"))
    return rows, *distinct.group_patterns(rows, F.col("cookie"), F.col("ad"))


def p6_ad_series(spark: SparkSession, d: str) -> DataFrame:
    """Distinct cookies of each series of ads (first four characters of adId), through patterns over all ads."""
    rows, totals, members = _ad_patterns(spark, d)
    combos = rows.where("ad is not null").select(F.substring("ad", 1, 4).alias("combo"), F.col("ad").alias("grp"), F.lit("any").alias("role")).distinct()
    return distinct.combined(totals, members, combos).select(F.col("combo").alias("series"), "n_distinct")


def p6_ad_combinations(spark: SparkSession, d: str) -> DataFrame:
    """Distinct cookies that saw both of, either of, and only the first of the two most shown ads of each series, through the same patterns."""
    rows, totals, members = _ad_patterns(spark, d)
    shown = rows.where("ad is not null").groupBy("ad").agg(F.count(F.lit(1)).alias("n")).withColumn("series", F.substring("ad", 1, 4))
    two = shown.groupBy("series").agg(F.max_by("ad", F.struct("n", "ad")).alias("first"), F.max("n").alias("n"))
    second = shown.join(two.select("series", "first"), "series").where("ad <> first").groupBy("series", "first").agg(F.max_by("ad", F.struct("n", "ad")).alias("second"))
    asked = {"both": ("all", "all"), "either": ("any", "any"), "only_first": ("all", "not")}
    each = [F.struct(F.concat_ws(" ", F.lit(k), "series").alias("combo"), F.col(ad).alias("grp"), F.lit(role).alias("role")) for k, roles in asked.items() for ad, role in zip(("first", "second"), roles)]
    found = distinct.combined(totals, members, second.select(F.explode(F.array(*each)).alias("x")).select("x.*"))
    return found.select(F.substring_index("combo", " ", 1).alias("kind"), F.expr("substring(combo, position(' ', combo) + 1)").alias("series"), "n_distinct")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_frequent(spark, d).select("field", "item")


def p7_frequent(spark: SparkSession, d: str) -> DataFrame:
    return heavy.frequent_items(table(spark, d, "logs_base"), ["referrer", "remoteAddr"])


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return Scratch(spark).write(tokens.token_counts(table(spark, d, "documents")), "tokens")


def _capacities(spark: SparkSession, d: str) -> list[int]:
    return sorted(r.capacity for r in table(spark, d, "container_sizes").where("capacity > 0").select("capacity").distinct().collect())  # a fixed table of a few rows


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_counts(spark, d), _capacities(spark, d))


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d))


def p8_over_limits(spark: SparkSession, d: str) -> DataFrame:
    """Containers beyond a limit that aren't a single uncut text: none."""
    return packing.over_limits(_packed(spark, d))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    counts = _counts(spark, d)
    return packing.checks(Scratch(spark).write(packing.pack(counts, _capacities(spark, d)), "packed"), counts)


def _sized(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").withColumn("source", mixing.source_key(F.col("source")))
    return Scratch(spark).write(tokens.token_counts(documents, keep=("source",)).select("doc_id", "source", "n_tokens"), "sized")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    sized = _sized(spark, d)
    return mixing.draw(sized, mixing.plan_mixture(sized, table(spark, d, "mix_targets")))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    sized = _sized(spark, d)
    plan = mixing.plan_mixture(sized, table(spark, d, "mix_targets"))
    return mixing.shares_reached(mixing.draw(sized, plan), plan)


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    return mixing.checks(p9_shares(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_documents(table(spark, d, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored_documents(table(spark, d, "documents"))


def p10_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether each check holds for all documents: see :func:`mojibake.checks`."""
    documents = table(spark, d, "documents")
    return mojibake.checks(documents, Scratch(spark).write(mojibake.restored_documents(documents), "restored"))


QUERIES = {
    f.__name__: f
    for f in (
        p4_percentiles, p4_host_percentiles, p4_within_stated_error, p4_hosts_within_stated_error, p6_distinct_counts, p6_weeks, p6_ad_series, p6_ad_combinations,
        p7_found, p7_frequent, p8_packing, p8_fill, p8_over_limits, p8_checks, p9_mixture, p9_shares, p9_checks, p10_found, p10_restored, p10_checks,
    )
}

_NAME = "nullif(nullif(trim({0}, ' ' || chr(9)), ''), '-')"
_ROWS = f"""(SELECT {_NAME.format('"userCookie"')} AS "userCookie", {_NAME.format('ip')} AS ip, {_NAME.format('"adId"')} AS "adId", {_NAME.format('referrer')} AS referrer, dt[:10] AS day
  FROM impressions WHERE try_strptime(dt[:10], '%Y-%m-%d') IS NOT NULL)"""


def _distinct_sql(period: str | None, name: str) -> str:
    """Per ad, and per ad and referrer, over ``period`` (all if None); per day, or the period, over all."""
    out = []
    for field, per in (("userCookie", "day"), ("ip", "day"), ("adId", "day"), ("userCookie", "ad"), ("ip", "ad"), ("userCookie", "ad_referrer"), ("ip", "ad_referrer")):
        own = period or ("day" if per == "day" else None)
        keys = ['"adId"'] * (per != "day") + ["referrer"] * (per == "ad_referrer")
        need = " AND ".join(f"{c} IS NOT NULL" for c in (f'"{field}"', *keys))
        shown = [f"{own or 'NULL::VARCHAR'} AS {name}", f'{keys[0] if keys else "NULL::VARCHAR"} AS "adId"', f"{keys[1] if len(keys) > 1 else 'NULL::VARCHAR'} AS referrer"]
        out.append(f"""SELECT '{field}' AS field, '{per}' AS per, {', '.join(shown)}, count(DISTINCT "{field}") AS n_distinct FROM {_ROWS} WHERE {need} GROUP BY {', '.join([*([own] if own else []), *keys])}""")
    return " UNION ALL ".join(out)


_FREQUENT = " UNION ALL ".join(
    f"""SELECT '{c}' AS field, "{c}" AS item, count(*) AS n, count(*) / (SELECT count(*) FROM logs_base) AS share FROM logs_base
  WHERE "{c}" IS NOT NULL AND "{c}" NOT IN ('', '-') GROUP BY 2 HAVING count(*) * 200 >= (SELECT count(*) FROM logs_base)""" for c in ("referrer", "remoteAddr")
)
ORACLE: dict[str, str] = {
    "p4_within_stated_error": """SELECT hostname, dt, count(*) AS n, true AS "within" FROM local_metrics
      WHERE hostname IS NOT NULL AND dt IS NOT NULL AND isfinite("requestTime") GROUP BY 1, 2""",
    "p4_hosts_within_stated_error": f"""SELECT hostname, count(*) AS n, {len(digests.QUANTILES)}::BIGINT AS n_quantiles, true AS "within" FROM local_metrics
      WHERE hostname IS NOT NULL AND dt IS NOT NULL AND isfinite("requestTime") GROUP BY 1""",
    "p10_checks": "SELECT unnest(['one_row_each', 'changed_only_where_replaced', 'lines_kept', 'ascii_lines_kept', 'lost_counted']) AS \"check\", true AS holds",
    "p6_distinct_counts": f"SELECT *, 0.0::DOUBLE AS error FROM ({_distinct_sql(None, 'day')})",
    "p6_weeks": _distinct_sql("strftime(date_trunc('week', strptime(day, '%Y-%m-%d')), '%Y-%m-%d')", "week"),
    "p6_ad_combinations": f"""WITH seen AS (SELECT DISTINCT "userCookie" AS u, "adId" AS a FROM (SELECT {_NAME.format('"userCookie"')} AS "userCookie", {_NAME.format('"adId"')} AS "adId" FROM impressions) WHERE "userCookie" IS NOT NULL AND "adId" IS NOT NULL),
      top AS (SELECT a[:4] AS series, max(a) FILTER (k = 1) AS a1, max(a) FILTER (k = 2) AS a2 FROM (SELECT a, row_number() OVER (PARTITION BY a[:4] ORDER BY count(*) DESC, a DESC) AS k FROM (SELECT {_NAME.format('"adId"')} AS a FROM impressions) WHERE a IS NOT NULL GROUP BY a) GROUP BY 1),
      ids AS (SELECT series, u, bool_or(a = a1) AS x, bool_or(a = a2) AS y FROM seen JOIN top ON a IN (a1, a2) WHERE a2 IS NOT NULL GROUP BY 1, 2)
      SELECT kind, series, count(*) AS n_distinct FROM (SELECT series, unnest(['both', 'either', 'only_first']) AS kind, unnest([x AND y, x OR y, x AND NOT y]) AS inside FROM ids) WHERE inside GROUP BY 1, 2""",
    "p6_ad_series": f"""SELECT "adId"[:4] AS series, count(DISTINCT "userCookie") AS n_distinct FROM (SELECT {_NAME.format('"userCookie"')} AS "userCookie", {_NAME.format('"adId"')} AS "adId" FROM impressions)
      WHERE "adId" IS NOT NULL AND "userCookie" IS NOT NULL GROUP BY 1""",
    "p8_over_limits": "SELECT 0::INTEGER AS capacity, 0::BIGINT AS container, 0::BIGINT AS used, 0::BIGINT AS segments, 0::BIGINT AS loss WHERE false",
    "p8_checks": """SELECT capacity, (SELECT count(*) FROM documents WHERE text <> '') AS n_docs, true AS tokens_once, true AS within_limits, true AS well_filled FROM container_sizes""",
    "p9_checks": """SELECT lower(trim(t.source, ' ' || chr(9))) AS source, max_repeats, count(doc_id) AS n_docs, true AS reached, true AS capped
      FROM mix_targets t LEFT JOIN documents d ON lower(trim(t.source, ' ' || chr(9))) = lower(trim(d.source, ' ' || chr(9))) GROUP BY 1, 2""",
    "p7_found": f"SELECT field, item FROM ({_FREQUENT})",
    "p7_frequent": _FREQUENT,
}
