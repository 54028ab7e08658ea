"""Time expressions; the session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The largest whole second of a timestamp, which holds microseconds in 64 bits.
LAST_SECOND = ((1 << 63) - 1) // 1_000_000


def time_bucket(ts: Column, seconds: int) -> Column:
    """Start of the bucket that holds a timestamp; buckets are aligned to 1970, also before it."""
    s = F.unix_seconds(ts)
    return F.timestamp_seconds(s - F.pmod(s, F.lit(seconds).cast("bigint")))


def bucket_name(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def whole_ms(c: Column) -> Column:
    """Milliseconds given as text of digits, spaces and tabs around them aside; null for other text and beyond a bigint."""
    t = F.btrim(c.cast("string"), F.lit(" \t"))
    return F.when(t.rlike(r"\A[0-9]+\z"), t.try_cast("bigint"))


def ms_to_text(ms: Column) -> Column:
    """'yyyy-MM-dd HH:mm:ss' of milliseconds since 1970 given as text; null if they are no number or no timestamp reaches so far."""
    s = F.call_function("div", whole_ms(ms), F.lit(1000))
    return F.date_format(F.timestamp_seconds(F.when(s <= LAST_SECOND, s)), "yyyy-MM-dd HH:mm:ss")


def hour_of_day(ts: Column) -> Column:
    return F.date_format(ts, "HH")


def elapsed_seconds(begin: Column, end: Column, parity: bool = False) -> Column:
    """(end - begin) / 1000 of millisecond texts. ``parity`` divides only the begin, as older scripts did by mistake."""
    b, e = whole_ms(begin), whole_ms(end)
    return e - b / 1000.0 if parity else (e - b) / 1000.0


def partition_window(dt: Column, start: str, end: str, lower_inclusive: bool = False) -> Column:
    """Partition names (yyyy-MM-dd-HH-mm) from start to before end, compared as text."""
    return (dt >= start if lower_inclusive else dt > start) & (dt < end)
