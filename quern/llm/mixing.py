"""Mixing sources to target weights by Poisson replication.

Every document draws its number of copies by inverting a Poisson distribution at a uniform number, one of
LEVELS, hashed from its id, so the draw depends on nothing but the id and the seed. The mean of a source is
the repetition that brings its tokens to its target, counting that copies stop at the source's cap. One pass sums the
tokens of each source at each level; from these sums it is known exactly what any mean draws, so the mean that comes nearest
to the target is found without further passes. Copies are exploded and ordered globally by a hash of document and copy.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import trimmed

SEED = 20_090_302
HEADROOM = 0.9  # share of the largest mixture that every source can serve; beyond, means grow fast as nearly every document reaches its cap
LEVELS = 4096


def source_key(c: Column) -> Column:
    """Sources compare trimmed and lower-cased."""
    return F.lower(trimmed(c))


def poisson_steps(mean: float, cap: int) -> list[float]:
    """P(X <= k) for k under ``cap``: a uniform number gives as many copies as there are steps not above it."""
    term, total, steps = math.exp(-mean), 0.0, []
    for k in range(cap):
        total += term
        steps.append(min(total, 1.0))
        term *= mean / (k + 1)
    return steps


def level(seed: int) -> Column:
    """A hash of doc_id and the seed as one of LEVELS numbers."""
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(LEVELS)).cast("int")


def copies_at(levels: np.ndarray, steps: list[float]) -> np.ndarray:
    """Copies of documents at the levels: the Poisson distribution inverted at the middle of each."""
    return np.searchsorted(steps, (levels + 0.5) / LEVELS, side="right")


def calibrated(at: np.ndarray, tokens: np.ndarray, wanted: float, cap: int) -> float:
    """The Poisson mean whose draw of a source comes nearest to ``wanted`` tokens, ``tokens`` being those at the levels ``at``."""

    def drawn(mean: float) -> float:
        return float((tokens * copies_at(at, poisson_steps(mean, cap))).sum())

    low, high = 0.0, 1.0
    while drawn(high) < wanted and high < 500:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if drawn(middle) < wanted else (low, middle)
    return min(low, high, key=lambda m: abs(drawn(m) - wanted))


def plan_mixture(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED) -> list[dict]:
    """Per listed source: share, cap, docs, tokens, planned tokens, the largest document and the calibrated Poisson mean.

    ``sized``: doc_id, source (as compared), n_tokens. ``targets``: source, target_share, max_repeats - a
    fixed small table, one row per source. Without ``total_tokens`` the mixture is as large as every source
    that has documents can serve its share, less some headroom; a source that can't is planned at its cap.
    The driver gets at most LEVELS rows for each listed source.
    """
    listed = {r.source: (r.target_share or 0.0, max(0, r.max_repeats or 0)) for r in targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").collect()}
    spark = sized.sparkSession
    named = spark.createDataFrame([(s,) for s in listed], "source string")
    per = sized.select("source", level(seed).alias("level"), "n_tokens").join(F.broadcast(named), "source").groupBy("source", "level")
    have: dict[str, list[tuple]] = {s: [] for s in listed}
    for r in per.agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"), F.max("n_tokens").alias("most")).collect():
        have[r.source].append((r.level, r.n, r.t or 0, r.most or 0))
    levels = {s: np.array(rows, dtype=np.int64).reshape(-1, 4) for s, rows in have.items()}
    size = {s: int(x[:, 2].sum()) for s, x in levels.items()}
    serving = [s for s, (w, cap) in listed.items() if w > 0 and cap > 0 and size[s]]
    if total_tokens is None:
        total_tokens = int(HEADROOM * min((listed[s][1] * size[s] / listed[s][0] for s in serving), default=0))
    wanted = {s: min(listed[s][0] * total_tokens, listed[s][1] * size[s]) for s in serving}
    return [
        {"source": s, "target_share": w, "max_repeats": cap, "n_docs": int(levels[s][:, 1].sum()), "source_tokens": size[s], "planned_tokens": int(wanted.get(s, 0)), "largest": int(levels[s][:, 3].max(initial=0)),
         "mean": calibrated(levels[s][:, 0], levels[s][:, 2], wanted[s], cap) if s in wanted else 0.0}
        for s, (w, cap) in listed.items()
    ]


def draw(sized: DataFrame, plan: list[dict], seed: int = SEED) -> DataFrame:
    """(doc_id, source, copy, n_tokens, shuffle_key): every drawn copy, globally ordered by shuffle_key.

    Documents without a listed source are never drawn; texts of 0 tokens may be, at no size.
    """
    spark, sized = sized.sparkSession, sized.select("doc_id", "source", "n_tokens")
    steps = spark.createDataFrame([(p["source"], poisson_steps(p["mean"], p["max_repeats"])) for p in plan if p["mean"] > 0], "source string, steps array<double>")
    copies = F.size(F.filter("steps", lambda s: s <= (level(seed) + 0.5) / LEVELS))
    counted = sized.join(F.broadcast(steps), "source").withColumn("n", copies).where("n > 0")
    copied = counted.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"), "n_tokens")
    return copied.withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), "doc_id", "copy")).orderBy("shuffle_key", "doc_id", "copy")


def shares_reached(drawn: DataFrame, plan: list[dict]) -> DataFrame:
    """Per listed source: target and reached share of all drawn tokens, what was planned, and the most copies of one document."""
    per = drawn.groupBy("source").agg(F.sum("n_tokens").alias("drawn_tokens"), F.count(F.lit(1)).alias("n_copies"), F.count_distinct("doc_id").alias("n_used"), F.max("copy").alias("most_copies"))
    columns = {"source": "string", "target_share": "double", "max_repeats": "int", "n_docs": "bigint", "source_tokens": "bigint", "planned_tokens": "bigint", "largest": "bigint"}
    listed = drawn.sparkSession.createDataFrame([tuple(p[c] for c in columns) for p in plan], ", ".join(f"{c} {t}" for c, t in columns.items()))
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("drawn_tokens", "n_copies", "n_used", "most_copies")]
    whole = F.sum("drawn_tokens").over(Window.partitionBy())  # over one row for each listed source
    return listed.join(per, "source", "left").select(*columns, *zero).withColumn("actual_share", F.coalesce(F.col("drawn_tokens") / F.when(whole > 0, whole), F.lit(0.0)))


def checks(shares: DataFrame) -> DataFrame:
    """Per listed source: documents, whether what was drawn is within 1 % of the plan or the largest document's tokens of it, and whether the cap holds."""
    off = F.abs(F.col("drawn_tokens") - F.col("planned_tokens"))
    near = off <= F.greatest(0.01 * F.col("planned_tokens"), F.col("largest").cast("double"))
    return shares.select("source", "max_repeats", "n_docs", near.alias("reached"), (F.col("most_copies") <= F.col("max_repeats")).alias("capped"))
