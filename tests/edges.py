"""Tables at the edges: empty ones, and ones of nulls only, with further columns whose names clash with the operators' own."""

from pyspark.sql import functions as F

EMPTY, NULLS = "empty", "nulls"
CLASHES = ("id", "key", "src", "kind", "h", "x", "unit", "value", "item", "field", "grp", "print", "n", "salt", "evhour", "arrival", "slot", "root", "row_id", "reason", "n_tokens", "steps", "copy", "seed", "shard", "capacity", "what", "k1")
TABLES = {
    "impressions": "requestBeginTime string, adId string, impressionId string, referrer string, userAgent string, userCookie string, ip string, dt string",
    "clicks": "impressionId string, dt string",
    "impression_removals": "impressionId string, dt string",
    "joined_impressions": "requestBeginTime string, adId string, impressionId string, referrer string, userAgent string, userCookie string, ip string, clicked boolean, day string, hour string",
    "raw_logs": "line_no bigint, line string",
    "logs_base": "log_id bigint, remoteAddr string, remoteLogname string, user string, time string, request string, status int, bytes_string string, referrer string, browser string",
    "local_metrics": "requestTime double, hostname string, dt string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, repo string, commit_id string, author string, committed_at timestamp, parents int, n_files int",
    "mix_targets": "source string, target_share double, max_repeats int",
    "container_sizes": "container_id int, capacity int",
}
IDS = {"raw_logs": "line_no", "logs_base": "log_id"}


def write_tables(spark, where, kind):
    """All tables in ``where``: without rows, or with five rows of nulls (row ids aside)."""
    for name, schema in TABLES.items():
        empty = spark.createDataFrame([], schema)
        df = empty
        if kind == NULLS:
            own = {IDS[name]: F.col("at")} if name in IDS else {}
            df = spark.range(5).withColumnRenamed("id", "at").select(*(own.get(c, F.lit(None)).cast(t).alias(c) for c, t in empty.dtypes))
        for c in CLASHES:
            if c not in df.columns:
                df = df.withColumn(c, F.lit("clash"))
        df.coalesce(1).write.parquet(f"{where}/{name}.parquet")
    return str(where)
