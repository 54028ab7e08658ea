"""Grouping activity into sessions by pointer doubling.

Events are first merged into nodes: all events of a key in one slot as wide as the gap lie at most a
gap apart, so they share a session and one node (first, last, count) stands for them. Partial
aggregation does that before the shuffle, however many events a key has. The only slot that can hold
a predecessor within the gap is the one before, so every node either links to it or is a root. Links
are doubled by self-joins on (key, slot) - P(x) becomes P(P(x)) - until all point at roots; a chain of n slots takes
log2(n) rounds, and no task ever sees all events of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def sessions(events: DataFrame, key: Column, ms: Column, gap_ms: int = 1_800_000) -> DataFrame:
    """One row per visit: key, start_ms, end_ms, duration_ms, n_events.

    A pause of more than ``gap_ms`` between consecutive events of a key starts a new visit. Events
    whose key or time is null belong to no visit. Ties and repeated rows are events of the same
    visit; one event makes a visit of duration 0; an empty table gives none.
    """
    if gap_ms < 1:
        raise ValueError("gap_ms must be positive")
    scratch = Scratch(events.sparkSession)
    slot = F.floor(F.col("ms") / F.lit(gap_ms)).cast("bigint")
    nodes = (
        events.select(key.alias("key"), ms.cast("bigint").alias("ms")).where("key is not null and ms is not null")
        .groupBy("key", slot.alias("slot")).agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"), F.count(F.lit(1)).alias("n"))
    )
    # Each node also tells the next slot its last event; one aggregation then finds every link.
    null = F.lit(None).cast("bigint")
    told = nodes.select("key", F.explode(F.array(
        F.struct("slot", "lo", "hi", "n", null.alias("before")),
        F.struct((F.col("slot") + 1).alias("slot"), null.alias("lo"), null.alias("hi"), null.alias("n"), F.col("hi").alias("before")),
    )).alias("x")).select("key", "x.*")
    linked = told.groupBy("key", "slot").agg(*(F.max(c).alias(c) for c in ("lo", "hi", "n", "before"))).where("n is not null")
    near = F.coalesce(F.col("lo") - F.col("before") <= gap_ms, F.lit(False))
    nodes = scratch.write(linked.select("key", "slot", "lo", "hi", "n", near.alias("near")), "nodes")

    first = nodes.where("near").select("key", "slot", (F.col("slot") - 1).alias("root"), F.lit(False).alias("done"))
    moving, finished = first, first.where("done")
    while not moving.isEmpty():
        # A pointer that leads to no link has reached a root; one that leads to a finished link takes over its root.
        to = finished.unionByName(moving).select("key", F.col("slot").alias("root"), F.col("root").alias("further"), F.col("done").alias("ended"))
        # Only links that moved are written; those that finished now are never touched again.
        moved = scratch.write(moving.join(to, ["key", "root"], "left").select(
            "key", "slot", F.coalesce("further", "root").alias("root"), F.coalesce("ended", F.lit(True)).alias("done")
        ), "links")
        moving, finished = moved.where("not done"), finished.unionByName(moved.where("done"))

    rooted = nodes.where("not near").select("key", F.col("slot").alias("root"), "lo", "hi", "n").unionByName(
        finished.select("key", "slot", "root").join(nodes.where("near").drop("near"), ["key", "slot"]).drop("slot")
    )
    return (
        rooted.groupBy("key", "root").agg(F.min("lo").alias("start_ms"), F.max("hi").alias("end_ms"), F.sum("n").alias("n_events"))
        .select("key", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "n_events")
    )
