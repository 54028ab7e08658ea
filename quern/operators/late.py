"""Late and out-of-order events: K-slack reordering with provisional, corrected and running figures.

A delivery belongs to an event hour and arrives in a later slot. The hour is published a while after
it starts (provisional) and closed much later (final). Each task reads its deliveries by arrival and
keeps them, hour by hour, in a buffer. When the clock passes an hour's publication, what its buffer
holds is counted and published; when the clock passes its closing - the lateness bound - the hour leaves
the buffer, sorted by arrival, for the final aggregation. That one depends on the order: the first
delivery of an id decides whether the id was on time or corrects what was published, later ones are
repeats, and each release step adds what is new to the hour's running figures. What arrives after closing
counts as dropped. Of each id only the first and the last delivery are shuffled.

An hour's deliveries are held once and looked at twice, at its publication and at its closing. A task
holds the deliveries of at most one lateness bound of arrivals, so the size of its buffer follows the arrival rate
of a partition, not the length of the table; ids, not hours, are spread over tasks, so one hour may hold any share of the rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import begin_ms, clean_id, hour_name, hour_slot, slot_minutes, slot_number

PUBLISH_MINUTES = 80
CLOSE_MINUTES = 25 * 60
RELEASED = "src string, id string, evhour bigint, arrival bigint, phase string, provisional bigint, final bigint, dropped bigint"


def id_arrivals(impressions: DataFrame, clicks: DataFrame) -> DataFrame:
    """One row per id: ``evhour`` (hours since 1970 of its valid begin time, else null) and the
    first and last arrival (minutes since 1970) of its impressions and of its clicks, null where there is none.

    Rows without an id and arrivals that are no ``yyyy-MM-dd-HH-mm`` count as nothing delivered. Deliveries between the first and the
    last are repeats that change no figure, so an id with a third of all rows is one row per task.
    """
    none = F.lit(None).cast("bigint")
    ident, arrival = clean_id(F.col("impressionId")).alias("id"), slot_number(F.col("dt"))
    seen = impressions.select(ident, begin_ms(F.col("requestBeginTime")).alias("ms"), arrival.alias("imp"), none.alias("clk"), F.lit(True).alias("known"))
    hits = clicks.select(ident, none.alias("ms"), none.alias("imp"), arrival.alias("clk"), F.lit(False).alias("known"))
    ends = [f(c).alias(f"{c}_{n}") for c in ("imp", "clk") for n, f in (("first", F.min), ("last", F.max))]
    per_id = seen.unionByName(hits).where("id is not null").groupBy("id").agg(F.min("ms").alias("ms"), F.max("known").alias("known"), *ends)
    minutes = [slot_minutes(F.col(f"{c}_{n}")).alias(f"{c}_{n}") for c in ("imp", "clk") for n in ("first", "last")]
    return per_id.select("id", "known", F.floor(F.col("ms") / 3_600_000).cast("bigint").alias("evhour"), *minutes)


def _ends(src: str, what: str) -> list[Column]:
    """The first delivery, and the last one where it is another."""
    first, last = F.col(f"{what}_first"), F.col(f"{what}_last")
    entry = lambda at, repeat: F.struct(F.lit(src).alias("src"), at.alias("arrival"), F.lit(repeat).alias("repeat"))
    return [F.when(first.isNotNull(), entry(first, False)), F.when(last > first, entry(last, True))]


def deliveries(ids: DataFrame) -> DataFrame:
    """(src, id, evhour, arrival, repeat) of the first and the last impression and click of each id with an event hour; ``repeat``
    tells whether the id was delivered before."""
    each = F.explode(F.array(*_ends("impressions", "imp"), *_ends("clicks", "clk"))).alias("x")
    return ids.where("known and evhour is not null").select("id", "evhour", each).where("x is not null").select("x.src", "id", "evhour", "x.arrival", "x.repeat")


def stale_publications(joined: DataFrame, ids: DataFrame) -> DataFrame:
    """(src, id, evhour, arrival, repeat) of published rows whose ``clicked`` is not true although the id was
    clicked: its first and last click against the hour the row was published under."""
    rows = joined.where(~F.coalesce(F.col("clicked"), F.lit(False))).select(clean_id(F.col("impressionId")).alias("id"), hour_slot(F.col("day"), F.col("hour")).alias("evhour"))
    rows = rows.where("id is not null and evhour is not null").distinct()
    clicked = ids.where("clk_first is not null").select("id", "clk_first", "clk_last")
    each = F.explode(F.array(*_ends("joined_impressions", "clk"))).alias("x")
    return rows.join(clicked, "id").select("id", "evhour", each).where("x is not null").select("x.src", "id", "evhour", "x.arrival", "x.repeat")


def _first_of_each(*columns: pa.ChunkedArray) -> np.ndarray:
    """Positions of the first row of each combination of values, in order."""
    key = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        coded = c.combine_chunks().dictionary_encode()
        _, key = np.unique(key * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)
    return np.sort(np.unique(key, return_index=True)[1])


def _k_slack(publish: int, close: int):
    columns = [x.split(" ")[0] for x in RELEASED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer: dict[int, list[pa.Table]] = {}
        due: list[tuple[int, int, int]] = []  # (minute, what, event hour): 0 to publish, 1 to close

        def counts(table: pa.Table, what: str, *more: str) -> Iterator[pa.RecordBatch]:
            """Rows of each (src, event hour, ...) under one of the three figures."""
            if not table.num_rows:
                return
            sums = table.group_by(["src", "evhour", *more]).aggregate([([], "count_all")])
            own = {c: sums[c] for c in ("src", "evhour", *more)} | {what: sums["count_all"]}
            kinds = {"id": pa.string(), "phase": pa.string()}
            yield from pa.table({c: own[c] if c in own else pa.nulls(sums.num_rows, kinds.get(c, pa.int64())) for c in columns}).to_batches()

        def held(hours: list[int]) -> pa.Table:
            """What the buffer has of some hours, each in order of arrival and each id once in it: its first delivery."""
            whole = pa.concat_tables([t for h in hours for t in buffer[h]]).sort_by([("evhour", "ascending"), ("arrival", "ascending")])
            return whole.take(pa.array(_first_of_each(whole["evhour"], whole["src"], whole["id"])))

        def publish_hours(hours: list[int]) -> Iterator[pa.RecordBatch]:
            table = held(hours)
            yield from counts(table.filter(pa.array(table["arrival"].to_numpy() < table["evhour"].to_numpy() * 60 + publish)), "provisional")

        def close_hours(hours: list[int]) -> Iterator[pa.RecordBatch]:
            table = held(hours)
            for h in hours:
                del buffer[h]
            yield from counts(table, "final", "arrival")
            late = table["arrival"].to_numpy() >= table["evhour"].to_numpy() * 60 + publish
            wrong = late | (table["src"].to_numpy() == "joined_impressions")
            n = int(wrong.sum())
            if n:
                chosen = table.filter(pa.array(wrong))
                phase = pa.array(np.where(late[wrong], "correction", "on_time").astype(object), pa.string())
                yield from pa.table({**{c: chosen[c] for c in columns[:4]}, "phase": phase, **{c: pa.nulls(n, pa.int64()) for c in columns[5:]}}).to_batches()

        def turn(clock: int) -> Iterator[pa.RecordBatch]:
            """Everything that is due when the clock stands there."""
            now: tuple[list[int], list[int]] = ([], [])
            while due and due[0][0] <= clock:
                _, what, hour = heapq.heappop(due)
                now[what].append(hour)
            for what, hours in zip((publish_hours, close_hours), now):
                if hours:
                    yield from what(hours)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            hour, at = table["evhour"].to_numpy(), table["arrival"].to_numpy()
            over = at >= hour * 60 + close
            lost = table.filter(pa.array(over & ~table["repeat"].to_numpy()))
            yield from counts(lost, "dropped")
            order = np.argsort(hour, kind="stable")
            order = order[~over[order]]
            fresh = table.select(["src", "id", "evhour", "arrival"]).take(pa.array(order))
            hours, starts = np.unique(hour[order], return_index=True)
            for h, a, b in zip(hours.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)]):
                if h not in buffer:
                    buffer[h] = []
                    heapq.heappush(due, (h * 60 + publish, 0, h))
                    heapq.heappush(due, (h * 60 + close, 1, h))
                buffer[h].append(fresh.slice(a, b - a))
            yield from turn(int(at[-1]))  # arrivals come sorted
        yield from turn(np.iinfo(np.int64).max)

    return run


def k_slack(events: DataFrame, publish_minutes: int = PUBLISH_MINUTES, close_minutes: int = CLOSE_MINUTES) -> DataFrame:
    """Reorder (src, id, evhour, arrival, repeat), the events of one (src, id, evhour) in one partition, and give RELEASED rows of two kinds.

    Rows with an id: ids whose first delivery came before closing and changes what was published
    (phase ``correction``), and for src ``joined_impressions`` also ``on_time`` ones. Rows
    without: partial counts of ids per src and event hour, to be summed - provisional (arrived before
    publication), final (before closing, one row per step of arrival) and dropped (only after closing). Rows without hour or
    arrival are left out; ties in arrival are released in any order, which no figure depends on.
    """
    rows = events.where("evhour is not null and arrival is not null").select("src", "id", "evhour", "arrival", F.coalesce("repeat", F.lit(False)).alias("repeat"))
    return rows.sortWithinPartitions("arrival").mapInArrow(_k_slack(publish_minutes, close_minutes), RELEASED)


def corrections(released: DataFrame) -> DataFrame:
    """The ids whose published hour must be corrected: src, id, evhour (hours since 1970)."""
    return released.where("id is not null").select("src", "id", "evhour").distinct()


def hourly_figures(released: DataFrame) -> DataFrame:
    """Per event hour: impressions and clicks as published, as corrected, and too late to count."""
    sums = released.where("id is null and src <> 'joined_impressions'").groupBy("evhour")
    each = [F.sum(F.when(F.col("src") == s, F.col(k)).otherwise(0)).alias(f"{s}_{k}") for s in ("impressions", "clicks") for k in ("provisional", "final", "dropped")]
    figures = [F.coalesce(c, F.lit(0)).alias(c) for c in (f"{s}_{k}" for s in ("impressions", "clicks") for k in ("provisional", "final", "dropped"))]
    return sums.agg(*each).select(hour_name(F.col("evhour")).alias("evhour"), *figures)


def running_figures(released: DataFrame) -> DataFrame:
    """(evhour, arrival, impressions, clicks, click_rate): an event hour's figures as they stood after each release step.

    ``arrival`` is the step's minute as ``yyyy-MM-dd HH:mm``; the rate is null while there is no impression. An hour has a
    row for at most every minute from its first delivery to its closing, summed over all tasks before they are put in order.
    """
    steps = released.where("id is null and final is not null and src <> 'joined_impressions'").groupBy("evhour", "arrival")
    new = steps.agg(*(F.sum(F.when(F.col("src") == s, F.col("final")).otherwise(0)).alias(s) for s in ("impressions", "clicks")))
    so_far = Window.partitionBy("evhour").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    run = new.select("evhour", "arrival", *(F.sum(s).over(so_far).alias(s) for s in ("impressions", "clicks")))
    rate = F.when(F.col("impressions") > 0, F.col("clicks") / F.col("impressions"))
    return run.select(hour_name(F.col("evhour")).alias("evhour"), F.date_format(F.timestamp_seconds(F.col("arrival") * 60), "yyyy-MM-dd HH:mm").alias("arrival"), "impressions", "clicks", rate.alias("click_rate"))
