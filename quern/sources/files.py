"""Readers: text and delimited lines, JSON tables and documents, dated log files, ratings, sequences."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import logs as L
from ..schemas import ALIGNMENT, RATING, SEQUENCE, WIKI_STAT

# Fixed value: how log files carry their hour in their name.
DATED_NAME = r".*\.(\d+-\d+-\d+-\d+)\..*"
# Bases of a chunk of a sequence, and how far chunks overlap unless told otherwise.
CHUNK, OVERLAP = 65_535, 1_024
PIECE_BASES = 65_535


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of plain or compressed text files."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_table(spark: SparkSession, path: str, schema: T.StructType = WIKI_STAT, sep: str = " ") -> DataFrame:
    """Delimited text under a fixed schema; a field that doesn't fit its type is null."""
    return spark.read.csv(path, schema=schema, sep=sep)


def read_json_table(spark: SparkSession, path: str, schema: T.StructType, partition: str = "dt") -> DataFrame:
    """One JSON record per line under a fixed schema; ``dt=...`` folders become a column, kept as text."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(partition, T.StringType())])).json(path)


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    """(json) of files that hold one JSON document each, those that are no JSON left out."""
    docs = spark.read.text(path, wholetext=True).select(F.col("value").alias("json"))
    return docs.where(F.get_json_object("json", "$").isNotNull())


def read_cdn_logs(spark: SparkSession, path: str, start: str = "1970-01-01-00", end: str | None = None) -> DataFrame:
    """Parsed CDN logs of all files below a folder whose name carries an hour from start to end, both included
    ('yyyy-MM-dd-HH', end defaulting to now). Files outside, or without an hour, are never opened; no file
    in the range is an error, as is a bad bound."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"))
    hour = F.try_to_timestamp(L.extract_or_null(F.col("file"), DATED_NAME), F.lit("yyyy-M-d-H"))
    last = F.to_timestamp(F.lit(end), "yyyy-MM-dd-HH") if end else F.current_timestamp()
    kept = lines.where((hour >= F.to_timestamp(F.lit(start), "yyyy-MM-dd-HH")) & (hour <= last))
    if kept.isEmpty():
        raise FileNotFoundError(f"no log file between {start} and {end or 'now'} below {path}")
    return L.parse_cdn(kept)


def parse_ratings(lines: DataFrame) -> DataFrame:
    """(user, item, rating) of white-space separated lines; others are left out."""
    f = F.split(F.trim("line"), r"\s+")
    rows = lines.select(F.get(f, F.lit(0)).alias("user"), F.get(f, F.lit(1)).alias("item"), F.get(f, F.lit(2)).try_cast("bigint").alias("rating"), F.size(f).alias("n"))
    return rows.where("n = 3 and rating is not null").select(*RATING.names)


def read_rating_files(spark: SparkSession, path: str) -> DataFrame:
    """(user, item, rating) of files that name their item in the first line, 'item:', followed by 'user,rating,date'."""
    files = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("lines"))
    rows = files.select(F.regexp_extract(F.col("lines")[0], r"^\s*([^:]+):", 1).alias("item"), F.explode(F.slice("lines", F.lit(2), F.size("lines"))).alias("line"))
    f = F.split("line", ",")
    return rows.where(F.size(f) == 3).select(F.trim(f[0]).alias("user"), "item", F.trim(f[1]).try_cast("bigint").alias("rating"))


def parse_titles(lines: DataFrame) -> DataFrame:
    """(item, name) of 'id,year,title' lines; the title may hold commas."""
    shape = r"^(\w+),(\w+),(.*)$"
    return lines.where(F.col("line").rlike(shape)).select(F.regexp_extract("line", shape, 1).alias("item"), F.regexp_extract("line", shape, 3).alias("name"))


PIECES = "file string, block bigint, nth int, at bigint, header string, seq string"


def _cut_records(piece_bases: int):
    """(line, file, block) in order to PIECES: the bases of each record in a block of a file, in pieces. ``nth`` counts the headers
    of the block, 0 being what continues the record of the block before; ``at`` counts the record's bases within the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unknown = {c: "N" for c in map(chr, range(33, 127)) if c not in "ACGT"}
        table = str.maketrans(unknown)
        rows: list[tuple] = []
        held: list[str] = []
        where, nth, at, size, header = None, 0, 0, 0, None

        def close() -> None:
            nonlocal at, size, header
            if held or header is not None:
                rows.append((*where, nth, at, header, "".join(held)))
            at, size, header = at + size, 0, None
            held.clear()

        def packed() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 6
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()))], ["file", "block", "nth", "at", "header", "seq"])

        for batch in batches:
            for line, *place in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if place != where:
                    close()
                    where, nth, at = place, 0, 0
                if line.startswith(">"):
                    close()
                    nth, at, header = nth + 1, 0, line[1:].strip()
                    continue
                bases = "".join(line.split()).upper().translate(table)
                held.append(bases)
                size += len(bases)
                if size >= piece_bases:
                    close()
            yield packed()
        close()
        yield packed()

    return run


def _numbered_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, offset, header, seq): pieces of records with the record's number, from 1 in file and header order, and their place in it.

    Files are read in blocks by many tasks; only one row per block, its headers and the bases after the last of them, is put in order in one place.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    pieces = lines.mapInArrow(_cut_records(PIECE_BASES), PIECES).where("nth > 0 or block > 0")
    records = pieces.groupBy("file", "block", "nth").agg(F.sum(F.length("seq")).alias("bases"))
    blocks = records.groupBy("file", "block").agg(F.max("nth").alias("headers"), F.max_by("bases", "nth").alias("tail"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    run = blocks.select("file", "block", "headers", F.coalesce(F.sum("headers").over(before), F.lit(0)).alias("first"), F.coalesce(F.sum("tail").over(before), F.lit(0)).alias("tails"))
    # The bases that the open record has before a block: all tails since the last block with a header.
    begun = F.last(F.when(F.col("headers") > 0, F.col("tails")), ignorenulls=True).over(before)
    run = run.select("file", "block", "first", (F.col("tails") - F.coalesce(begun, F.lit(0))).alias("carried"))
    carried = F.when(F.col("nth") == 0, F.col("carried")).otherwise(0)
    return pieces.join(run, ["file", "block"]).select((F.col("first") + F.col("nth")).alias("seq_id"), (F.col("at") + carried).alias("offset"), "header", "seq")


def _joined(pieces: DataFrame, *keys: str) -> DataFrame:
    return pieces.groupBy(*keys).agg(F.max("header").alias("header"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "seq"))), lambda p: p["seq"]), "").alias("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, header, seq): whole sequences in normal form, numbered from 1 in file and header order. For reads and other short
    records; long ones are read by :func:`read_sequences`. Bases before a file's first header are left out."""
    return _joined(_numbered_pieces(spark, path), "seq_id").select("seq_id", "header", "seq")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, header) of the same records."""
    return _numbered_pieces(spark, path).where("header is not null").select("seq_id", "header")


def read_sequences(spark: SparkSession, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(seq_id, chunk, offset, last_chunk, seq): the same sequences in chunks of ``chunk`` bases and up to ``overlap`` further ones, whatever
    their length. A record without bases has one empty chunk."""
    pieces = _numbered_pieces(spark, path)
    end = F.col("offset") + F.length("seq")
    first, last = F.floor(F.greatest(F.lit(0), F.col("offset") - overlap) / chunk), F.floor(F.greatest(F.col("offset"), end - 1) / chunk)
    each = pieces.select("seq_id", "offset", "seq", F.explode(F.sequence(first, last)).alias("chunk"))
    start = F.greatest("offset", F.col("chunk") * chunk)
    n = F.least(end, (F.col("chunk") + 1) * chunk + overlap) - start
    cut = each.select("seq_id", "chunk", start.alias("offset"), F.lit(None).cast("string").alias("header"), F.substr("seq", (start - F.col("offset") + 1).cast("int"), F.greatest(n, F.lit(0)).cast("int")).alias("seq"))
    sizes = pieces.groupBy("seq_id").agg(F.max(end).alias("size"))
    whole = _joined(cut, "seq_id", "chunk").join(sizes, "seq_id").withColumn("offset", F.col("chunk") * chunk)
    return whole.withColumn("last_chunk", F.col("size") <= F.col("offset") + chunk).select(*SEQUENCE.names)


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ALIGNMENT).parquet(path)


def register_partitions(spark: SparkSession, name: str, path: str, schema: T.StructType, *columns: str, source: str = "parquet") -> DataFrame:
    """A table of the catalog over the partition folders ``column=value`` below a path, all of which are registered; folders that
    appear later are registered by calling again. Gives the table."""
    if not spark.catalog.tableExists(name):
        listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE {name} ({listed}) USING {source} PARTITIONED BY ({', '.join(columns)}) LOCATION '{path}'")
    spark.catalog.recoverPartitions(name)
    return spark.table(name)


def add_partition(spark: SparkSession, name: str, path: str, **values: str) -> None:
    """Register one partition of such a table, whatever its folder is called; nothing happens if it is registered."""
    spec = ", ".join(f"{k} = '{v}'" for k, v in values.items())
    spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION ({spec}) LOCATION '{path}'")


def partitions(spark: SparkSession, name: str) -> DataFrame:
    """(partition) of all that are registered, as ``column=value/...``."""
    return spark.sql(f"SHOW PARTITIONS {name}")
