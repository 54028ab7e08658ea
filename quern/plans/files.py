"""Queries that write the given tables out in the library's file formats and read them back through its sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators import alignment, keyed, log_reports
from ..schemas import CLICK, IMPRESSION
from ..scratch import Scratch
from ..sinks.kv import FolderStore, KVSink, ParquetStore
from ..sinks.tables import export_delimited, overwrite_partitions, write_report
from ..sources import files
from . import reports
from .reports import ORACLE as REPORTS_ORACLE
from .reports import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
CHUNK, OVERLAP = 40, 7


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


@query("SELECT count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM raw_logs WHERE line IS NOT NULL AND NOT regexp_matches(line, '[\\r\\n]')")
def file_lines(spark: SparkSession, d: str) -> DataFrame:
    """Log lines through compressed text files; lines that hold an end of line can't be lines of a file."""
    path = f"{Scratch(spark).root}/lines"
    table(spark, d, "raw_logs").where("line is not null and not line rlike '[\\r\\n]'").select("line").write.option("compression", "gzip").text(path)
    return files.read_lines(spark, path).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("""SELECT l_partkey::VARCHAR AS pagename, sum(l_quantity)::BIGINT AS views, count(l_suppkey) AS n FROM lineitem GROUP BY 1""")
def file_delimited(spark: SparkSession, d: str) -> DataFrame:
    """Page counts through space-separated text under the fixed schema."""
    path = f"{Scratch(spark).root}/pages"
    rows = table(spark, d, "lineitem").select(F.lit("en"), F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int"), F.col("l_suppkey").cast("int"))
    export_delimited(rows, path, sep=" ")
    return files.read_table(spark, path).groupBy("pagename").agg(F.sum("pageviews").alias("views"), F.count("pagesize").alias("n"))


@query("""SELECT dt[:10] AS dt, count(*) AS n, count("impressionId") AS n_ids, count(DISTINCT "userAgent") AS n_agents FROM impressions WHERE dt IS NOT NULL GROUP BY 1""")
def file_json_table(spark: SparkSession, d: str) -> DataFrame:
    """Impressions through JSON lines in folders by day."""
    path = f"{Scratch(spark).root}/impressions"
    rows = table(spark, d, "impressions").where("dt is not null").withColumn("dt", F.substring("dt", 1, 10))
    rows.repartition("dt").write.partitionBy("dt").json(path)
    read = files.read_json_table(spark, path, IMPRESSION)
    return read.groupBy("dt").agg(F.count(F.lit(1)).alias("n"), F.count("impressionId").alias("n_ids"), F.count_distinct("userAgent").alias("n_agents"))


@query('SELECT dt[:10] AS dt, count(*) AS n, count("impressionId") AS n_ids FROM clicks WHERE dt IS NOT NULL GROUP BY 1')
def file_registered_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Clicks of each day through partition folders registered in the catalog, counted by the partitions it shows."""
    root = Scratch(spark).root
    name = f"clicks_{root.rsplit('-', 1)[1]}"
    rows = table(spark, d, "clicks").where("dt is not null").withColumn("dt", F.substring("dt", 1, 10))
    rows.repartition("dt").write.partitionBy("dt").parquet(f"{root}/clicks")
    read = files.register_partitions(spark, name, f"{root}/clicks", StructType([*CLICK.fields, StructField("dt", StringType())]), "dt")
    shown = files.partitions(spark, name).select(F.split("partition", "=")[1].alias("dt"))
    return shown.join(read, "dt").groupBy("dt").agg(F.count(F.lit(1)).alias("n"), F.count("impressionId").alias("n_ids"))


@query("SELECT l_suppkey::VARCHAR AS item, count(*) AS n, sum(l_quantity)::BIGINT AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def file_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Ratings through white-space separated lines."""
    path = f"{Scratch(spark).root}/ratings"
    rows = reports.ratings(spark, d).select(F.concat_ws("\t", "user", "item", "rating").alias("line"))
    rows.write.text(path)
    return files.parse_ratings(files.read_lines(spark, path)).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("total"))


@query("SELECT p_partkey::VARCHAR AS item, p_name || ', ' || p_brand AS name FROM part")
def file_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles with commas through 'id,year,title' lines."""
    path = f"{Scratch(spark).root}/titles"
    table(spark, d, "part").select(F.concat(F.col("p_partkey"), F.lit(",1999,"), F.col("p_name"), F.lit(", "), F.col("p_brand")).alias("line")).write.text(path)
    return files.parse_titles(files.read_lines(spark, path))


def _fasta(spark: SparkSession, d: str, path: str) -> None:
    """Each reference as a header and two lines of bases, one of them in small letters."""
    half = F.lit(reports.READ_LEN * 3 // 2)
    record = F.concat(F.lit(">ref "), F.col("ref_id"), F.lit("\n"), F.substr("seq", F.lit(1), half), F.lit("\n"), F.lower(F.substr("seq", half + 1, half)))
    reports.sequences(spark, d).select(record.alias("line")).write.text(path)


@query(f"SELECT 'ref ' || ref_id AS header, s AS seq FROM {reports._REFS}")
def file_fasta(spark: SparkSession, d: str) -> DataFrame:
    """Sequences through FASTA files, each read whole."""
    path = f"{Scratch(spark).root}/fasta"
    _fasta(spark, d, path)
    return files.read_fasta(spark, path).select("header", "seq")


@query(f"""SELECT 'ref ' || ref_id AS header, k::BIGINT AS chunk, k * {CHUNK}::BIGINT AS "offset", length(s) <= (k + 1) * {CHUNK} AS last_chunk, s[k * {CHUNK} + 1:k * {CHUNK} + {CHUNK + OVERLAP}] AS seq
  FROM (SELECT *, unnest(range(0, (length(s) - 1) // {CHUNK} + 1)) AS k FROM {reports._REFS})""")
def file_sequence_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The same files in overlapping chunks, with the header that the table of headers has for each number."""
    path = f"{Scratch(spark).root}/fasta"
    _fasta(spark, d, path)
    chunks = files.read_sequences(spark, path, chunk=CHUNK, overlap=OVERLAP)
    return chunks.join(files.read_headers(spark, path), "seq_id").select("header", "chunk", "offset", "last_chunk", "seq")


@query(f"SELECT concat_ws(chr(9), ref_id, ref_start, ref_end, read_id, differences, CASE WHEN is_rc THEN '-' ELSE '+' END) AS line FROM {reports._ALIGNED}")
def file_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Alignments through their table, shown as lines."""
    path = f"{Scratch(spark).root}/alignments"
    reports.align_mismatch(spark, d).write.parquet(path)
    return alignment.alignment_text(files.read_alignments(spark, path))


@query(f"""SELECT read_id, ref_id, ref_start, is_rc, w || chr(10) || list_aggregate(list_transform(range(1, {reports.READ_LEN + 1}), lambda p: CASE WHEN w[p] = q[p] THEN '|' ELSE ' ' END), 'string_agg', '') || chr(10) || q AS picture
  FROM (SELECT a.*, r.s[ref_start + 1:ref_end] AS w, CASE WHEN is_rc THEN translate(reverse(e.q), 'ACGT', 'TGCA') ELSE e.q END AS q FROM {reports._ALIGNED} a JOIN {reports._REFS} r USING (ref_id) JOIN {reports._READS} e USING (read_id))""")
def alignment_pictures(spark: SparkSession, d: str) -> DataFrame:
    shown = alignment.alignment_pictures(reports.align_mismatch(spark, d), reports.sequences(spark, d).select("ref_id", "seq"), reports.reads(spark, d))
    return shown.select("read_id", "ref_id", "ref_start", "is_rc", "picture")


@query("""SELECT coalesce(c.id, n.id) AS id, coalesce(n."name", 'empty') AS "Name", c."count"::VARCHAR AS "Count" FROM (SELECT (user_id * 11)::VARCHAR AS id, count(*) AS "count" FROM events GROUP BY 1) c
  FULL OUTER JOIN (SELECT c_custkey::VARCHAR AS id, min(c_name) AS "name" FROM customer GROUP BY 1) n ON c.id = n.id""")
def kv_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Counts, then names, upserted into the key-value table; names replace the placeholder that came with the counts."""
    store = ParquetStore(f"{Scratch(spark).root}/store")
    counts = table(spark, d, "events").groupBy((F.col("user_id") * 11).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("Count"))
    names = table(spark, d, "customer").groupBy(F.col("c_custkey").cast("string").alias("id")).agg(F.min("c_name").alias("Name"))
    store.upsert(counts.withColumn("Name", F.lit(keyed.NAMELESS)), "items", "id")
    store.upsert(names, "items", "id")
    return store.items(spark, "items").select(F.col("name").alias("id"), F.col("attributes")["Name"][0].alias("Name"), F.col("attributes")["Count"][0].alias("Count"))


@query("""SELECT c_custkey::VARCHAR AS id, c_name AS "name" FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey::VARCHAR, 'empty' FROM customer WHERE c_custkey % 3 = 0""")
def keyed_names(spark: SparkSession, d: str) -> DataFrame:
    """Names from tab-separated lines, of which some lack their second field, merged with the ids that are counted."""
    path = f"{Scratch(spark).root}/names"
    rows = table(spark, d, "customer")
    ident = F.concat(F.lit("/guid/"), F.col("c_custkey"))
    rows.select(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat_ws("\t", "c_name", ident)).alias("line")).write.text(path)
    merged = keyed.kv_merge(rows.select(ident.alias("id"), F.lit(1).alias("count")), keyed.names_of(files.read_lines(spark, path)))
    return merged.select(F.substring_index("id", "/", -1).alias("id"), "name")


@query("""SELECT path, count(*) AS n, min(value) AS least, max(value) AS most FROM (SELECT unnest(['id', 'tags.0', 'tags.1.name', 'at.day', 'none']) AS path,
    unnest([event_id::VARCHAR, event_type, user_id::VARCHAR, strftime(ts, '%Y-%m-%d'), NULL]) AS value FROM events) GROUP BY 1""")
def activity_json_paths(spark: SparkSession, d: str) -> DataFrame:
    """The values of each dotted path of events written as nested JSON."""
    tags = F.concat(F.lit('['), F.to_json(F.array("event_type")).substr(F.lit(2), F.length("event_type") + 2), F.lit(', {"name": '), F.col("user_id"), F.lit("}]"))
    doc = F.concat(F.lit('{"id": '), F.col("event_id"), F.lit(', "tags": '), tags, F.lit(', "at": {"day": "'), F.date_format("ts", "yyyy-MM-dd"), F.lit('"}, "none": null, "empty": {}}'))
    paths = keyed.json_paths(table(spark, d, "events").select("event_id", doc.alias("json")), "event_id")
    return paths.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("SELECT strftime(ts, '%d %b %Y') AS key_date, count(*) AS n, sum(event_id)::BIGINT AS ids, count(DISTINCT user_id) AS n_authors FROM events GROUP BY 1")
def activity_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Flattened interactions written as JSON lines by day, read back and counted."""
    path = f"{Scratch(spark).root}/flat"
    flat = keyed.interactions(reports.activity_documents(spark, d))
    keyed.as_json(flat).select(F.concat_ws("\t", "key_date", "json").alias("line")).write.text(path)
    lines = files.read_lines(spark, path).select(F.split("line", "\t", 2).alias("f"))
    one = lambda k: F.get_json_object(F.col("f")[1], f"$.{k}")
    return lines.groupBy(F.col("f")[0].alias("key_date")).agg(F.count(F.lit(1)).alias("n"), F.sum(one("interaction_id").cast("bigint")).alias("ids"), F.count_distinct(one("author_id")).alias("n_authors"))


@query(f"""SELECT block, num_requests::VARCHAR AS num_requests, num_bytes FROM ({REPORTS_ORACLE['access_top_blocks']})""")
def file_report(spark: SparkSession, d: str) -> DataFrame:
    """The report of address blocks through its file."""
    frame = log_reports.access_log_reports(reports._access(spark, d))["top_50_ips"]
    path = write_report(frame, Scratch(spark).root, "top_50_ips")
    return spark.read.csv(path, sep="\t", schema="block string, num_requests string, num_bytes string")


@query("""SELECT day, hour, count(*) AS n, count(*) FILTER (clicked) AS n_clicked FROM joined_impressions WHERE day IS NOT NULL AND hour IS NOT NULL GROUP BY 1, 2""")
def file_overwritten_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Joined impressions by day and hour, first without and then, hour by hour in place of the first, with their clicks."""
    path = f"{Scratch(spark).root}/joined"
    rows = table(spark, d, "joined_impressions").where("day is not null and hour is not null").select("impressionId", "clicked", "day", "hour").repartition("day", "hour")
    overwrite_partitions(rows.withColumn("clicked", F.lit(None).cast("boolean")), path, "day", "hour")
    overwrite_partitions(rows, path, "day", "hour")
    read = spark.read.schema("impressionId string, clicked boolean, day string, hour string").parquet(path)
    return read.groupBy("day", "hour").agg(F.count(F.lit(1)).alias("n"), F.count_if("clicked").alias("n_clicked"))


@query("""SELECT hostname || ':' || dt AS name, count(*)::VARCHAR AS "count", max("requestTime") AS most FROM local_metrics WHERE isfinite("requestTime") AND hostname IS NOT NULL AND dt IS NOT NULL GROUP BY 1""")
def kv_sink(spark: SparkSession, d: str) -> DataFrame:
    """Figures per host and day written item by item, in batches, to a key-value store, twice, the second time in place of the first."""
    store = FolderStore(f"{Scratch(spark).root}/kv")
    rows = table(spark, d, "local_metrics").where(F.col("hostname").isNotNull() & F.col("dt").isNotNull() & (F.abs("requestTime") < float("inf")))
    figures = rows.groupBy("hostname", "dt").agg(F.count(F.lit(1)).alias("count"), F.max("requestTime").alias("most"), F.lit("").alias("blank"))
    sink = KVSink(store, "hosts", ("hostname", "dt"))
    sink.write(figures.withColumn("count", F.lit(0)))
    sink.write(figures)
    one = lambda k: F.max(F.when(F.col("attribute") == k, F.col("values")[0])).alias(k)
    return store.items(spark, "hosts").groupBy("name").agg(one("count"), one("most")).withColumn("most", F.col("most").cast("double"))


@query(f"""SELECT "IP", count(*) AS n, sum("Bytes")::HUGEINT::VARCHAR AS total FROM {reports._CDN} WHERE ts IS NOT NULL GROUP BY 1""")
def file_cdn_logs(spark: SparkSession, d: str) -> DataFrame:
    """CDN logs through compressed files whose names carry their date, beside one without a date, which isn't read."""
    root = Scratch(spark).root
    lines = reports.cdn_lines(table(spark, d, "logs_base")).where("line not like '#%'")
    day = F.to_date(F.try_to_timestamp(F.substring("line", 1, 10), F.lit("yyyy-MM-dd"))).cast("string")
    dated = lines.select("line", day.alias("day")).where("day is not null")
    dated.repartition("day").write.partitionBy("day").option("compression", "gzip").text(f"{root}/staged")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{root}/cdn"))
    for folder in fs.listStatus(path(f"{root}/staged")):  # a folder for each day
        if folder.isDirectory():
            for k, part in enumerate(fs.listStatus(folder.getPath())):
                fs.rename(part.getPath(), path(f"{root}/cdn/X.{folder.getPath().getName()[4:]}-00.{k}.gz"))
    spark.range(1).select(F.lit("not a log").alias("line")).write.text(f"{root}/cdn/other")
    days = sorted(s.getPath().getName()[2:12] for s in fs.listStatus(path(f"{root}/cdn")) if s.isFile())
    logs = files.read_cdn_logs(spark, f"{root}/cdn", f"{days[0]}-00", f"{days[-1]}-23") if days else files.L.parse_cdn(lines)
    return logs.groupBy("IP").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("Bytes").cast("decimal(38,0)")).cast("string").alias("total"))
