"""Identifiers and event times as this library compares them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t"


def trimmed(c: Column) -> Column:
    """Without spaces and tabs at both ends; null stays null."""
    return F.btrim(c, F.lit(BLANKS))


def present(c: Column) -> Column:
    """Null for null, empty and ``-``, else the value as it is."""
    return F.when((c != "") & (c != "-"), c)


def clean_id(c: Column) -> Column:
    """The id as compared: trimmed and lower-cased; null, empty and ``-`` are no id (null)."""
    return present(F.lower(trimmed(c)))


def begin_ms(c: Column) -> Column:
    """Milliseconds since 1970, if the text is exactly 13 digits after trimming, else null."""
    t = trimmed(c)
    return F.when(t.rlike(r"\A[0-9]{13}\z"), t.cast("bigint"))


def slot_number(c: Column) -> Column:
    """A ``yyyy-MM-dd-HH-mm`` partition name as the number yyyyMMddHHmm, which sorts as it does; null if it is none."""
    return F.when(c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}-[0-9]{2}-[0-9]{2}\z"), F.translate(c, "-", "").cast("bigint"))


def slot_minutes(number: Column) -> Column:
    """Minutes since 1970 of such a number; null if there is no such time."""
    return (F.unix_timestamp(F.try_to_timestamp(number.cast("string"), F.lit("yyyyMMddHHmm"))) / 60).cast("bigint")


def hour_slot(day: Column, hour: Column) -> Column:
    """Hours since 1970 of ``yyyy-MM-dd`` and ``HH``; null if they are none."""
    both = F.concat_ws("-", day, hour)
    return F.when(
        both.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}-[0-9]{2}\z"),
        (F.unix_timestamp(F.try_to_timestamp(both, F.lit("yyyy-MM-dd-HH"))) / 3600).cast("bigint"),
    )


def hour_name(slot: Column) -> Column:
    """``yyyy-MM-dd-HH`` of an hour since 1970 (session time zone UTC)."""
    return F.date_format(F.timestamp_seconds(slot * 3600), "yyyy-MM-dd-HH")
