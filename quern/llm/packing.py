"""Filling fixed-capacity containers by vector bin packing.

Every piece of text has three sizes - tokens, one segment, loss-bearing tokens - and a container a limit
for each. Texts are dealt to shards of bounded size by a hash; a task packs its shard with the
dot-product heuristic: into the open container goes the fitting text whose sizes, weighted by how
scarce each resource is, have the largest dot product with what the container has left.

A text longer than the capacity has to be cut, so it is cut to the room that whole texts leave under all
limits: loss-bearing tokens as far as the loss limit goes, then tokens of prompts. Each container takes
whole texts only up to their share of all tokens left, so that what can be cut is spread over containers and meets
whole texts, whose prompts make up for its loss-bearing tokens. Shards hold thousands of texts, so the one container per shard that may
stay half empty weighs little.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_PIECES = 8192
MAX_SEGMENTS = 64
LOSS_SHARE = 0.95
PART_CONTAINERS = 64  # a text of more capacities than this is dealt to shards in parts of so many
LEAST_PIECE = 64  # pieces shorter than one of so many parts of a capacity aren't cut off
PACKED = "capacity int, container bigint, doc_id bigint, start_token bigint, n_tokens bigint, n_loss bigint, is_whole boolean"


def items(counts: DataFrame, capacities: list[int]) -> DataFrame:
    """(capacity, doc_id, copy, part, start_token, n_tokens, n_loss, is_whole) for each capacity: texts that fit, and parts of
    those that have to be cut. Equal rows of ``counts`` are told apart by ``copy``; texts of 0 tokens need no container and are left out."""
    copies = counts.where("n_tokens > 0").groupBy("doc_id", "n_tokens", "n_prompt").agg(F.count(F.lit(1)).alias("copies"))
    each = copies.select("doc_id", "n_tokens", "n_prompt", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
    each = each.select("*", F.explode(F.array(*(F.lit(c).cast("int") for c in capacities)).cast("array<int>")).alias("capacity"))
    size = F.when(F.col("n_tokens") > F.col("capacity"), F.col("capacity").cast("bigint") * PART_CONTAINERS).otherwise(F.col("n_tokens"))
    parts = each.select("*", size.alias("size"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.call_function("div", F.col("n_tokens") - 1, size))).alias("part"))
    start = F.col("part") * F.col("size")
    end = F.least(start + F.col("size"), F.col("n_tokens"))
    loss = F.greatest(F.lit(0).cast("bigint"), end - F.greatest(start, F.col("n_prompt")))
    return parts.select("capacity", "doc_id", "copy", "part", start.alias("start_token"), (end - start).alias("n_tokens"), loss.alias("n_loss"), (F.col("n_tokens") <= F.col("capacity")).alias("is_whole"))


class Stock:
    """Tokens of one kind that may be cut anywhere: (row, first token, number) of each stretch, in order."""

    def __init__(self, stretches: list[tuple[int, int, int]]):
        self.stretches = deque(x for x in stretches if x[2])
        self.left = sum(x[2] for x in stretches)

    def take(self, room: int, segments: int, least: int) -> list[tuple[int, int, int]]:
        """Up to ``room`` tokens in at most so many pieces, none under ``least`` unless its stretch ends with it."""
        out = []
        while self.stretches and room and len(out) < segments:
            row, start, n = self.stretches[0]
            m = min(n, room)
            if m < min(least, n):
                break
            out.append((row, start, m))
            room, self.left = room - m, self.left - m
            if m == n:
                self.stretches.popleft()
            else:
                self.stretches[0] = (row, start + m, n - m)
        return out


def fill(tokens: np.ndarray, loss: np.ndarray, whole: np.ndarray, start: np.ndarray, capacity: int, max_segments: int, max_loss: int) -> list[tuple[int, int, int, int, int]]:
    """(row, container, first token, tokens, loss-bearing tokens) of all pieces of one shard. No container is beyond a limit but those
    of a whole text that is so by itself, which gets one of its own. Loss-bearing tokens are the last ones of each row; ``max_loss`` is at least 1."""
    rows = np.flatnonzero(whole)
    order = rows[np.lexsort((-loss[rows], -tokens[rows]))]
    t, b = tokens[order].astype(np.float64), loss[order].astype(np.float64)
    n = len(t)
    cut = np.flatnonzero(~whole)
    prompts = Stock([(int(i), int(start[i]), int(tokens[i] - loss[i])) for i in cut])
    losses = Stock([(int(i), int(start[i] + tokens[i] - loss[i]), int(loss[i])) for i in cut])
    # Scarcity of each resource: what everything asks for, in containers' worth.
    scarce = np.array([tokens.sum() / capacity, len(tokens) / max_segments, loss.sum() / max_loss])
    scarce /= scarce.max()
    ta, sa, la = scarce[0] * t / capacity**2, scarce[1] / max_segments**2, scarce[2] * b / max_loss**2
    least = max(1, min(max_loss, capacity // LEAST_PIECE))
    left, descending = np.ones(n, dtype=bool), -t
    remaining, whole_left, first, container = n, float(t.sum()), 0, -1
    out: list[tuple[int, int, int, int, int]] = []
    while remaining or losses.left or prompts.left:
        container += 1
        if 2 * remaining < len(t):  # what is placed needn't be looked at again
            order, t, b, ta, la, descending = (x[left] for x in (order, t, b, ta, la, descending))
            n, first, left = len(t), 0, np.ones(len(t), dtype=bool)
        room, segments, may_lose = capacity, max_segments, max_loss
        stock = losses.left + prompts.left
        # Whole texts may take their share of the container, the first one more than that.
        quota = capacity * whole_left / (whole_left + stock) if stock else float(capacity)
        while remaining and segments:
            while not left[first]:
                first += 1
            fits = room if segments == max_segments else min(room, quota)
            at = max(first, int(np.searchsorted(descending, -fits)))  # sorted by tokens, so those that fit are a suffix
            if at >= n:
                break
            ok = left[at:] & (b[at:] <= may_lose)
            if ok.any():
                i = at + int(np.where(ok, ta[at:] * room + sa * segments + la[at:] * may_lose, -1.0).argmax())
            elif segments == max_segments:
                i = first  # its loss alone is beyond the limit
            else:
                break
            left[i] = False
            remaining -= 1
            out.append((int(order[i]), container, int(start[order[i]]), int(t[i]), int(b[i])))
            room, segments, may_lose = room - int(t[i]), segments - 1, may_lose - int(b[i])
            quota, whole_left = quota - t[i], whole_left - t[i]
            if may_lose < 0:
                room = segments = 0
        for what, limit in ((losses, may_lose), (prompts, capacity)):
            for row, at, m in what.take(min(room, max(0, limit)), segments, least):
                out.append((row, container, at, m, m if what is losses else 0))
                room, segments = room - m, segments - 1
    return out


def _pack_shard(max_segments: int, loss_share: float):
    def run(table: pa.Table) -> pa.Table:
        capacity, shard = table["capacity"][0].as_py(), table["shard"][0].as_py()
        table = table.sort_by([("doc_id", "ascending"), ("part", "ascending"), ("n_tokens", "ascending"), ("copy", "ascending")])
        whole = table["is_whole"].to_numpy()
        pieces = fill(table["n_tokens"].to_numpy(), table["n_loss"].to_numpy(), whole, table["start_token"].to_numpy(), capacity, max_segments, int(loss_share * capacity))
        row, container, start, n, loss = (np.array(c, dtype=np.int64) for c in zip(*pieces))
        return pa.table({
            "capacity": pa.repeat(pa.scalar(capacity, pa.int32()), len(row)), "container": pa.array((shard << 32) + container), "doc_id": table["doc_id"].combine_chunks().take(pa.array(row)),
            "start_token": pa.array(start), "n_tokens": pa.array(n), "n_loss": pa.array(loss), "is_whole": pa.array(whole[row]),
        })

    return run


def pack(counts: DataFrame, capacities: list[int], max_segments: int = MAX_SEGMENTS, loss_share: float = LOSS_SHARE) -> DataFrame:
    """PACKED: every piece of every text with its container, for each capacity; ``container`` is unique among those of a capacity.

    ``counts``: doc_id, n_tokens, n_prompt (read twice; write it first). A container holds at most
    ``capacity`` tokens, ``max_segments`` pieces and ``loss_share * capacity`` loss-bearing tokens; only a text that fits the
    capacity, so that it may not be cut, but has more loss-bearing tokens is beyond that, alone in its container. Texts are placed in
    doc_id order where they are equal, so the result doesn't depend on how rows arrive; repeated and null doc_ids are placed as often as they occur.
    Limits that leave no room for one loss-bearing token or one piece raise ValueError.
    """
    if max_segments < 1 or any(int(loss_share * c) < 1 for c in capacities):
        raise ValueError("the limits leave no room for a token")
    if not capacities:
        capacities, counts = [1], counts.limit(0)
    parts = [F.sum(F.when(F.col("n_tokens") > c, F.ceil(F.col("n_tokens") / (c * PART_CONTAINERS))).otherwise(1)).alias(str(c)) for c in capacities]
    n_items = counts.where("n_tokens > 0").agg(*parts).first()
    shards = F.create_map(*(F.lit(x) for c in capacities for x in (c, max(1, -(-(n_items[str(c)] or 0) // SHARD_PIECES)))))
    home = F.xxhash64("doc_id", "part", "n_tokens", "n_loss", "copy")
    dealt = items(counts, capacities).withColumn("shard", F.pmod(home, shards[F.col("capacity")]).cast("int"))
    return dealt.groupBy("capacity", "shard").applyInArrow(_pack_shard(max_segments, loss_share), PACKED)


def _containers(packed: DataFrame) -> DataFrame:
    alone = (F.count(F.lit(1)) == 1) & F.max("is_whole")
    return packed.groupBy("capacity", "container").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("segments"), F.sum("n_loss").alias("loss"), alone.alias("is_single"))


def _over(max_segments: int, loss_share: float) -> Column:
    return (F.col("used") > F.col("capacity")) | (F.col("segments") > max_segments) | (F.col("loss") > F.lit(loss_share) * F.col("capacity"))


def over_limits(packed: DataFrame, max_segments: int = MAX_SEGMENTS, loss_share: float = LOSS_SHARE) -> DataFrame:
    """(capacity, container, used, segments, loss) of containers beyond a limit that aren't a single uncut text; there should be none."""
    return _containers(packed).where(_over(max_segments, loss_share) & ~F.col("is_single")).drop("is_single")


def fill_report(packed: DataFrame, max_segments: int = MAX_SEGMENTS, loss_share: float = LOSS_SHARE) -> DataFrame:
    """Per capacity: containers, tokens, the share of space used, the fewest containers tokens alone would allow, and
    the single uncut texts that are beyond a limit by themselves (``n_single_over``)."""
    report = _containers(packed).groupBy("capacity").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("most_tokens"), F.max("segments").alias("most_segments"), F.max("loss").alias("most_loss"),
        F.count_if(_over(max_segments, loss_share) & F.col("is_single")).alias("n_single_over"))
    return report.select("*", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("fill"), F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_containers"))


def checks(packed: DataFrame, counts: DataFrame) -> DataFrame:
    """Per capacity: n_docs placed, and whether every token of each stands in one piece (``tokens_once``), no container is beyond a limit
    (``within_limits``), and containers are at most 1 % and one more than tokens alone would need (``well_filled``). For unique doc_ids."""
    own = packed.groupBy("capacity", "doc_id").agg(F.sum("n_tokens").alias("placed"), F.sum("n_loss").alias("placed_loss"), F.array_sort(F.collect_list(F.struct("start_token", "n_tokens"))).alias("p"))
    end = F.aggregate("p", F.lit(0).cast("bigint"), lambda at, x: F.when(x["start_token"] == at, at + x["n_tokens"]).otherwise(F.lit(-1).cast("bigint")))
    once = F.coalesce((end == F.col("n_tokens")) & (F.col("placed") == F.col("n_tokens")) & (F.col("placed_loss") == F.col("n_tokens") - F.col("n_prompt")), F.lit(False))
    docs = own.join(counts.where("n_tokens > 0").select("doc_id", "n_tokens", "n_prompt"), "doc_id", "full_outer").groupBy("capacity").agg(F.count(F.lit(1)).alias("n_docs"), F.every(once).alias("tokens_once"))
    over = over_limits(packed).groupBy("capacity").agg(F.count(F.lit(1)).alias("n_over"))
    well = (F.col("n_containers") <= F.ceil(F.col("least_containers") * 1.01) + 1).alias("well_filled")
    report = fill_report(packed).select("capacity", well)
    return docs.join(report, "capacity").join(over, "capacity", "left").select("capacity", "n_docs", "tokens_once", F.col("n_over").isNull().alias("within_limits"), "well_filled")
