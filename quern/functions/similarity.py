"""Column formulas of confidence-adjusted item similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shrinkage of small co-rating counts, and the normal quantile of a 95 % interval.
SHRINK = 20
CONFIDENCE = 1.96
LARGEST_R = 0.9999


def log_scale(rating: Column) -> Column:
    """floor(ln rating) + 1; null below 1, where the scale isn't defined."""
    return F.when(rating >= 1, F.floor(F.ln(rating)).cast("bigint") + 1)


def sample_probability(cutoff: float, user_count: Column, item_count: Column) -> Column:
    """max(cutoff / ratings of the user, cutoff / ratings of the item); an unknown item doesn't raise it."""
    by_item = F.when(item_count > 0, F.lit(float(cutoff)) / item_count)
    return F.greatest(F.lit(float(cutoff)) / user_count, by_item)


def hash_uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) that depends on the values' texts and the seed alone, not on partitioning: 60 bits of their MD5."""
    digits = F.substring(F.md5(F.concat_ws("|", *(c.cast("string") for c in cols), F.lit(str(seed)))), 1, 15)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 60))


def pearson(sxx: Column, sx: Column, sxy: Column, sy: Column, syy: Column, n: Column) -> Column:
    """Correlation from sums, rounded to four places; 0 where a side doesn't vary."""
    sxx, sx, sxy, sy, syy, n = (c.cast("double") for c in (sxx, sx, sxy, sy, syy, n))
    spread = F.sqrt(F.greatest(F.lit(0.0), (n * sxx - sx * sx) * (n * syy - sy * sy)))
    return F.when(spread == 0, 0.0).otherwise(F.round((n * sxy - sx * sy) / spread, 4))


def similarity_score(r: Column, n: Column, n_users: int) -> Column:
    """The end of r's confidence interval nearer to zero, shrunk for few co-ratings and scaled by ln n / ln N.

    Fewer than four co-ratings score 0. If the interval of a negative r reaches above zero, its smaller
    end in size counts; if that of a positive r reaches below, the score is 0.
    """
    n = n.cast("double")
    r = F.greatest(F.lit(-LARGEST_R), F.least(F.lit(LARGEST_R), r))
    half = F.lit(CONFIDENCE) / F.sqrt(n - 3)
    low, high = F.tanh(F.atanh(r) - half), F.tanh(F.atanh(r) + half)
    low = F.when((r >= 0) & (low < 0), 0.0).otherwise(low)
    nearer = F.when(low * high < 0, F.least(F.abs(low), F.abs(high))).otherwise(F.least(low, high))
    return F.when(n < 4, 0.0).otherwise(nearer * F.pow(n / (n + SHRINK), F.lit(2.0)) * F.ln(n) / F.ln(F.lit(float(n_users))))
