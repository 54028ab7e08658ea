"""Parsing of access-log and CDN-log lines with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import extract_or_null

# The layouts of both logs, what is taken from fields, and the time formats.
ACCESS_LINE = r'^(\S+) (\S+) (\S+) \[([\w:/]+\s[+\-]\d{4})\] "(.+?)" (\S+) (\S+) "([^"]*)" "([^"]*)"'
ACCESS_FIELDS = ("remoteAddr", "remoteLogname", "user", "time", "request", "status", "bytes_string", "referrer", "browser")
ACCESS_TIME = "dd/MMM/yyyy:HH:mm:ss Z"
CDN_LINE = r"^(\S+\s+\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+\S+\s+(.*)$"
CDN_FIELDS = ("DateTime", "EdgeLocation", "Bytes", "IP", "Operation", "Domain", "Object", "HTTPResponse", "UserAgent")
CDN_TIME = "yyyy-MM-dd HH:mm:ss"
ADDRESS_BLOCK = r"(\d+\.\d+\.\d+)"
HTTP_HOST = r"(http://[a-z0-9.-]+)"
SEARCH_ENGINES = (r".*bing.*", r".*google.*")
SEARCH_TERM = r".*[&?]q=([^&]+).*"


def _whole_number(c: Column) -> Column:
    """Text of digits with an optional sign as a bigint, else null."""
    return F.when(c.rlike(r"\A[+-]?[0-9]+\z"), c.try_cast("bigint"))


SEPARATOR = "\u0001"


def _fields(lines: DataFrame, line: Column, pattern: str, names: tuple[str, ...]) -> DataFrame:
    """The pattern's groups as columns, all null where it isn't found from the line's start.

    The expression runs once a line, not once a field: the line is rewritten as its groups between separators
    and split. Lines that hold the separator themselves are read group by group.
    """
    whole = F.regexp_replace(line, f"{pattern}(?s:.*)", SEPARATOR.join(f"${i}" for i in range(1, len(names) + 1)))
    groups = F.when(line.rlike(pattern), F.split(whole, SEPARATOR))
    # The one-element explode keeps later filters on the fields from being pushed below and matching again.
    found = lines.select(line.alias("line"), F.explode(F.array(groups)).alias("f"))
    plain = F.size("f") == len(names)
    return found.select(*(F.when(plain, F.get("f", F.lit(i))).when(F.col("f").isNotNull(), F.regexp_extract("line", pattern, i + 1)).alias(n) for i, n in enumerate(names)))


def parse_access(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """The nine fields, typed ``status``, ``dtime`` (UTC) and ``bytes`` ('-' counts as 0) of each line that
    follows the layout from its start; other lines get nulls throughout. Columns of ``lines`` are not kept."""
    return typed_access(_fields(lines, F.col(line_col), ACCESS_LINE, ACCESS_FIELDS).withColumn("status", _whole_number(F.col("status")).try_cast("int")))


def typed_access(logs: DataFrame) -> DataFrame:
    """Adds ``dtime`` and ``bytes`` to rows that hold the nine fields; '-' counts as 0 bytes, and what isn't a
    number that a bigint can hold is null."""
    size = F.replace("bytes_string", F.lit("-"), F.lit("0"))
    return logs.withColumns({"dtime": F.try_to_timestamp("time", F.lit(ACCESS_TIME)), "bytes": F.when(size.rlike(r"\A[0-9]+\z"), size.try_cast("bigint"))})


def without_comments(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Lines but those that start with '#'; null lines are dropped too."""
    return lines.where(~F.startswith(F.col(line_col), F.lit("#")))


def parse_cdn(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Nine fields and ``ts`` of every CDN-log line; one field before the user agent is ignored. Comment
    lines and lines of another layout are left out; date and time may be separated by any white space."""
    out = _fields(without_comments(lines, line_col), F.col(line_col), CDN_LINE, CDN_FIELDS).where("DateTime is not null")
    return out.withColumns({"Bytes": _whole_number(F.col("Bytes")), "ts": F.try_to_timestamp(F.regexp_replace("DateTime", r"\s+", " "), F.lit(CDN_TIME))})


def address_block(c: Column) -> Column:
    """'a.b.c.*' of an address, null where it has no three leading numbers."""
    return F.concat(extract_or_null(c, ADDRESS_BLOCK), F.lit(".*"))


def referrer_host(c: Column) -> Column:
    """'http://host' in lower case letters, null for other referrers."""
    return extract_or_null(c, HTTP_HOST)


def search_term(c: Column) -> Column:
    """The raw q= value of a referrer; null if there is none."""
    return extract_or_null(c, SEARCH_TERM)
