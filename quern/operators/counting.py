"""Counts, top lists and grouped totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import list_tokens, word_pieces


def top(df: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    """The n rows with the largest ``by``; ties are decided by the other columns named, ascending. Nulls come last."""
    return df.orderBy(F.desc_nulls_last(by), *ties).limit(n)


def word_count(df: DataFrame, text: str) -> DataFrame:
    """(word, n): lower-cased words of all rows; null texts hold none."""
    each = df.select(F.explode(word_pieces(F.col(text))).alias("word")).where("word <> ''")
    return each.groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def token_count(df: DataFrame, text: str, prefix: str, anywhere: bool = False) -> DataFrame:
    """(token, n) of the white-space or comma separated tokens that start with ``prefix``, or hold it anywhere."""
    token = F.col("token")
    keep = F.contains(token, F.lit(prefix)) if anywhere else F.startswith(token, F.lit(prefix))
    return df.select(F.explode(list_tokens(F.col(text))).alias("token")).where(keep).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def totals(df: DataFrame, key: Column, name: str, **sums: str) -> DataFrame:
    """Rows and sums per key; a null key is a group of its own. ``sums``: result name = column of whole numbers, whose
    sums are decimals, as a few of the largest bigints add up to more than a bigint holds."""
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("num_requests"), *(whole_sum(c).alias(k) for k, c in sums.items()))


def whole_sum(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(20,0)")).cast("decimal(38,0)")
