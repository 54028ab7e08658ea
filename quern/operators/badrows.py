"""Rows that fail to parse: access-log lines apart from their reasons for failure.

A line is assembled quote-aware and read by Python's strict csv reader inside the partition's
task; what the reader raises is the reason, and only then typed constructors see the fields.
A last exact check of the raw text catches what the reader forgives (a quoted status, a doubled quote).
"""

from __future__ import annotations

import csv
import datetime as dt
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The layout's month names and the largest byte count.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
MAX_BYTES = 9223372036854775807

PARSED = "row_id bigint, reason string, remoteAddr string, remoteLogname string, user string, time string, request string, status int, bytes_string string, referrer string, browser string, dtime timestamp, bytes bigint"


class BadField(ValueError):
    """A field that a typed constructor refuses; the argument is the reason."""


def stamp(text: str, shape: re.Pattern[str]) -> dt.datetime:
    m = shape.fullmatch(text)
    if not m or m[2] not in MONTHS:
        raise BadField("bad_time")
    day, month, year, hour, minute, second, sign, oh, om = m.groups()
    try:
        local = dt.datetime(int(year), MONTHS.index(month) + 1, int(day), int(hour), int(minute), int(second))
    except ValueError:
        raise BadField("bad_time") from None
    off = dt.timedelta(hours=int(oh), minutes=int(om))
    try:
        return local + off if sign == "-" else local - off
    except OverflowError:
        return local


def status_of(text: str) -> int:
    if not (len(text) == 3 and text.isascii() and text.isdigit() and 100 <= int(text) <= 599):
        raise BadField("bad_status")
    return int(text)


def bytes_of(text: str) -> int:
    if text == "-":
        return 0
    if not (text.isascii() and text.isdigit()) or len(text.lstrip("0")) > 19 or int(text) > MAX_BYTES:
        raise BadField("bad_bytes")
    return int(text)


def parse_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_id, line) batches to PARSED batches; a reason is null exactly for valid lines."""
    csv.field_size_limit(sys.maxsize)
    clock = re.compile(r"([0-9]{2})/([A-Za-z]{3})/([0-9]{4}):([0-9]{2}):([0-9]{2}):([0-9]{2}) ([+-])([0-9]{2})([0-9]{2})")
    quoted = r'"(?:[^"\\]|\\.)*"'
    exact = re.compile(rf"{quoted} [0-9]{{3}} (?:-|[0-9]+) {quoted} {quoted}", re.S)
    run = re.compile(r"\S+")

    def parse(line: str | None) -> tuple:
        if line is None:
            raise BadField("null_line")
        if "\n" in line:
            raise BadField("embedded_newline")
        # Quote-aware assembly: three bare runs and the bracketed time lead the record, the quoted rest follows.
        head = line.rstrip(" \t\r").split(" ", 3)
        if len(head) < 4:
            raise BadField("field_count")
        if not all(run.fullmatch(x) for x in head[:3]):
            raise BadField("spacing")
        time, closed, rest = head[3].partition("]")
        if not closed or time[:1] != "[":
            raise BadField("bad_time")
        if rest[:1] != " ":
            raise BadField("spacing")
        fields = next(csv.reader([rest[1:]], delimiter=" ", quotechar='"', escapechar="\\", strict=True))
        if len(fields) != 5:
            raise BadField("field_count")
        when = stamp(time[1:], clock)
        if not fields[0]:
            raise BadField("empty_request")
        status, size = status_of(fields[1]), bytes_of(fields[2])
        if not exact.fullmatch(rest, 1):
            raise BadField("layout")
        return None, *head[:3], time[1:], fields[0], status, fields[2], fields[3], fields[4], when.replace(tzinfo=dt.UTC), size

    names = [x.split(" ")[0] for x in PARSED.split(", ")][1:]
    kinds = {"status": pa.int32(), "dtime": pa.timestamp("us", "UTC"), "bytes": pa.int64()}
    for batch in batches:
        rows = []
        for line in batch.column(1).to_pylist():
            try:
                rows.append(parse(line))
            except BadField as e:
                rows.append((str(e), *[None] * 11))
            except (csv.Error, StopIteration):
                rows.append(("quoting", *[None] * 11))
        columns = list(zip(*rows)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, columns))], ["row_id", *names])


def parse_access_lines(lines: DataFrame, id_col: str = "line_no", line_col: str = "line") -> DataFrame:
    """Every line with ``row_id``, ``reason`` (null if it is valid) and its typed fields (null if not).

    Reasons: null_line, embedded_newline, field_count, spacing, quoting, bad_time, empty_request,
    bad_status, bad_bytes, layout. Rows are independent of each other, so nothing is shuffled; an
    empty table gives an empty result, repeated lines are parsed each, other columns are ignored.
    Inside quotes a backslash is removed and the next character kept.
    """
    return lines.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(line_col).alias("line")).mapInArrow(parse_records, PARSED)


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is not null").select("row_id", "reason")


def loaded(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is null").drop("reason")


def _refused(construct: Callable, values: pa.Array) -> np.ndarray:
    """Which values a typed constructor refuses; each distinct value is tried once a batch, null is refused."""
    coded = values.dictionary_encode()
    bad = np.ones(len(coded.dictionary) + 1, dtype=bool)
    for i, x in enumerate(coded.dictionary.to_pylist()):
        try:
            construct(str(x))
            bad[i] = False
        except BadField:
            pass
    return bad[coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)]


def check_loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_id, status, bytes_string) batches to the (row_id, reason) of rows whose fields the typed constructors refuse."""
    for batch in batches:
        status, size = _refused(status_of, batch.column(1)), _refused(bytes_of, batch.column(2))
        reason = np.where(status, "bad_status", "bad_bytes").astype(object)
        either = pa.array(status | size)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(either), pa.array(reason, pa.string()).filter(either)], ["row_id", "reason"])


def rejected_loaded(rows: DataFrame, id_col: str = "log_id") -> DataFrame:
    """(row_id, reason) of already loaded rows that can't be right: bad_status, else bad_bytes. Their ``status`` and
    ``bytes_string`` go, untrimmed, through the constructors that parsed lines go through; nulls are refused.
    Rows are independent of each other; an empty table gives no rows."""
    return rows.select(F.col(id_col).cast("bigint").alias("row_id"), F.col("status").cast("int"), "bytes_string").mapInArrow(check_loaded, "row_id bigint, reason string")
