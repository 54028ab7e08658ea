"""Distinct counts over huge identifier sets, exact, through membership patterns.

Each identifier is reduced to the set of groups that contain it; identical sets - patterns - are counted, and the count of any
combination of groups is the sum over the patterns that make it up.

Where the groups are days, a pattern is a bit mask for every 62 days, put together by bitwise-or, which combines
before the shuffle: an identifier with a third of all rows is one row per task. Masks are made once for the finest keys
(ad and referrer) and rolled up to coarser ones (ad, nothing), so every shuffle but the first moves rows that are already reduced.
Membership tables of separate days or partitions merge by or-ing the masks per identifier.

Where the groups are without bound (ads), a pattern is summed up by hashes of the set, and any union, intersection or difference of groups
is answered from the patterns' totals.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 62
def day_number(day: Column) -> Column:
    """Days since 1970 of ``yyyy-MM-dd``, null if it is none."""
    return F.when(day.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.unix_date(day.try_cast("date")))


def mask_columns(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if c.startswith("m_"))


def memberships(rows: DataFrame, idents: dict[str, Column], keys: list[Column], day: Column, keyless: dict[str, Column] | None = None) -> list[DataFrame]:
    """The mergeable partial results, one for all keys, one for all but the last, and so on to none: (field, k1, k2, ..., id, m_<word>...), the
    days of each identifier under each key. ``field`` is the identifier's number, those of ``keyless`` coming last; these count under no key.

    Rows without a day or without identifier belong to none; a null key stays null and counts nowhere (see
    :func:`pattern_totals`), though the row counts for coarser keys. There is one mask column for every 62 days in
    which the table has a row; which these are is found first, and is all the driver gets.
    """
    number = day_number(day)
    days = rows.select(day.alias("day")).distinct()  # days are few, so only these are read as dates
    words = sorted(r.w for r in days.select(F.floor(day_number(F.col("day")) / WORD).cast("int").alias("w")).where("w is not null").distinct().collect()) or [0]
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(number, F.lit(WORD)).cast("int"))
    names = [f"k{i + 1}" for i in range(len(keys))]
    none = [F.lit(None).cast("string")] * len(keys)
    each = [*((c, keys) for c in idents.values()), *((c, none) for c in (keyless or {}).values())]
    structs = [F.when(c.isNotNull(), F.struct(F.lit(i).alias("field"), c.alias("id"), *(k.cast("string").alias(n) for k, n in zip(own, names)))) for i, (c, own) in enumerate(each)]
    cut = rows.select(number.alias("number"), bit.alias("bit"), F.explode(F.array(*structs)).alias("x")).where("x is not null and number is not null")
    masks = [F.bit_or(F.when(F.floor(F.col("number") / WORD) == w, F.col("bit")).otherwise(F.lit(0).cast("bigint"))).alias(f"m_{w}") for w in words]
    levels = [cut.groupBy("x.field", *(f"x.{n}" for n in names), "x.id").agg(*masks)]
    for n in range(len(names) - 1, -1, -1):
        levels.append(levels[-1].groupBy("field", *names[:n], "id").agg(*(F.bit_or(f"m_{w}").alias(f"m_{w}") for w in words)))
    return levels


def key_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == "field" or c[0] == "k" and c[1:].isdigit()]


def merge(*parts: DataFrame) -> DataFrame:
    """Membership tables of one level, of separate days or partitions, as one."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    zero = F.lit(0).cast("bigint")
    return whole.groupBy(*key_columns(whole), "id").agg(*(F.coalesce(F.bit_or(m), zero).alias(m) for m in mask_columns(whole)))


def _counted(members: DataFrame, *by: str) -> DataFrame:
    """Identifiers per ``by``, where no key is null. The conditions are part of the count, and not a filter, and read the masks, so that all counts
    of one level share its shuffle."""
    masks = mask_columns(members)
    ok = F.lit(True)
    for k in key_columns(members):
        ok = ok & F.col(k).isNotNull()
    some = F.lit(False)
    for m in masks:
        some = some | (F.col(m) != 0)
    return members.groupBy(*by).agg(F.count_if(ok & some).alias("n_ids")).where("n_ids > 0")


def pattern_totals(members: DataFrame) -> DataFrame:
    """(field, k1, ..., m_<word>..., n_ids): identifiers with exactly that set of days."""
    return _counted(members, *key_columns(members), *mask_columns(members))


def distinct_in_all(members: DataFrame) -> DataFrame:
    """(field, k1, ..., n_distinct) over all days; as :func:`distinct_over` gives it, without making out the patterns."""
    return _counted(members, *key_columns(members)).withColumnRenamed("n_ids", "n_distinct")


def distinct_over(patterns: DataFrame, days: list[str] | None = None) -> DataFrame:
    """(field, k1, ..., n_distinct) over any set of days (all if None), exactly."""
    chosen = patterns
    if days is not None:
        touch = F.lit(False)
        wanted: dict[str, int] = {}
        for x in days:
            word, bit = divmod((dt.date.fromisoformat(x) - dt.date(1970, 1, 1)).days, WORD)
            wanted[f"m_{word}"] = wanted.get(f"m_{word}", 0) | 1 << bit
        for m in mask_columns(patterns):
            touch = touch | (F.col(m).bitwiseAND(F.lit(wanted.get(m, 0)).cast("bigint")) != 0)
        chosen = patterns.where(touch)
    return chosen.groupBy(*key_columns(patterns)).agg(F.sum("n_ids").alias("n_distinct"))


def distinct_by_period(patterns: DataFrame, start: Callable[[Column], Column] = lambda day: day) -> DataFrame:
    """(field, k1, ..., period, n_distinct): the count of every period that has any, periods being named by their first day,
    which ``start`` gives for each day (a date); without it, days. A pattern counts once for each period it touches."""

    def days_of(m: str) -> Column:
        word = int(m[2:])
        bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.call_function("bit_get", F.col(m), b) == 1)
        return F.transform(bits, lambda b: start(F.date_from_unix_date(b + word * WORD)))

    periods = F.explode(F.array_distinct(F.concat(*map(days_of, mask_columns(patterns))))).alias("period")
    each = patterns.select(*key_columns(patterns), "n_ids", periods)
    return each.groupBy(*key_columns(patterns), "period").agg(F.sum("n_ids").alias("n_distinct")).withColumn("period", F.date_format("period", "yyyy-MM-dd"))


def group_patterns(pairs: DataFrame, ident: Column, group: Column) -> tuple[DataFrame, DataFrame]:
    """Membership patterns over any number of groups: (totals, members).

    An identifier's set of groups is summed up by its size, the sum and the exclusive-or of the groups'
    hashes - all combine before the shuffle, no set is ever collected. ``totals``: pattern, n_ids;
    ``members``: pattern, grp - the groups of each pattern, read off one identifier that has it.
    Two sets with equal size, 64-bit sum and 64-bit xor (of another hash) would be taken for one; at a trillion patterns
    the chance of any such pair is below 1e-14, and that is all that can make a count inexact.
    """
    distinct = pairs.select(ident.alias("id"), group.alias("grp")).where("id is not null and grp is not null").groupBy("id", "grp").agg(F.lit(1).alias("one"))
    wide = F.xxhash64("grp").cast("decimal(20,0)")
    sets = distinct.groupBy("id").agg(F.count(F.lit(1)).alias("size"), F.sum(wide).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), "grp")).alias("xor"))
    totals = sets.groupBy("size", "sum", "xor").agg(F.count(F.lit(1)).alias("n_ids"), F.min("id").alias("id"))
    named = totals.select(F.concat_ws(":", "size", "sum", "xor").alias("pattern"), "n_ids", "id")
    return named.select("pattern", "n_ids"), distinct.join(named.select("id", "pattern"), "id").select("pattern", "grp")


def combined(totals: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """(combo, n_distinct) of combinations given as (combo, grp, role), each group once: identifiers in all groups of role ``all``, in at
    least one of role ``any`` if there are such, and in none of role ``not``. A combination needs a group of role
    ``all`` or ``any``; one without identifiers has no row."""
    roles = ("all", "any", "not")
    count = lambda r: F.count_if(F.col("role") == r)
    asked = wanted.groupBy("combo").agg(*(count(r).alias(f"n_{r}") for r in roles))
    touched = members.join(wanted, "grp").groupBy("combo", "pattern").agg(*(count(r).alias(f"has_{r}") for r in roles))
    fits = touched.join(asked, "combo").where("has_all = n_all and has_not = 0 and (n_any = 0 or has_any > 0) and n_all + n_any > 0")
    return fits.join(totals, "pattern").groupBy("combo").agg(F.sum("n_ids").alias("n_distinct"))
