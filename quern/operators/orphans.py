"""References to records that do not exist.

Keys are spread over ranges of a 64-bit hash of the id, so every range holds about the
same number of parents whatever the ids look like. In each range the parents are sorted
arrays; references stream past in Arrow batches and are looked up by binary search. Equal
hashes are told apart by the id itself. Parents and references are combined by id in their tasks, HELD_ROWS at a time,
and shuffled once, to the ranges, where they are combined again; an id with a third of all rows arrives as a few
rows per task. Only misses, which are few, are shuffled a second time, to be added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import clean_id, slot_number

MISSES = "src string, id string, period string, reason string, n_refs bigint"
STATE = {"present": "max", "first_at": "min", "removed": "max", "removed_at": "min"}
PARENTS_PER_RANGE = 500_000
HELD_ROWS = 200_000


def parent_states(parents: DataFrame, removals: DataFrame) -> DataFrame:
    """Few rows per id, to be combined: ``present`` (ever delivered), ``first_at``, ``removed`` and ``removed_at`` (slot numbers).

    Rows without an id are left out; a dt that is no partition name counts as delivered at no known time.
    """

    def side(df: DataFrame, gone: bool) -> DataFrame:
        at, none = slot_number(F.col("dt")), F.lit(None).cast("bigint")
        return df.select(
            clean_id(F.col("impressionId")).alias("id"), F.lit(not gone).alias("present"), (none if gone else at).alias("first_at"),
            F.lit(gone).alias("removed"), (at if gone else none).alias("removed_at"),
        ).where("id is not null")

    return side(parents, False).unionByName(side(removals, True)).mapInArrow(_combine(["id"], STATE), "id string, present boolean, first_at bigint, removed boolean, removed_at bigint")


def timed_references(df: DataFrame, src: str) -> DataFrame:
    """References that ask whether the record was there at their own dt; the period is dt."""
    return df.select(F.lit(src).alias("src"), clean_id(F.col("impressionId")).alias("id"), F.col("dt").alias("period"), F.lit(True).alias("timed")).where("id is not null")


def lasting_references(df: DataFrame, src: str) -> DataFrame:
    """References that ask whether the record exists at all; the period is ``day-hour``."""
    period = F.concat(F.col("day"), F.lit("-"), F.col("hour"))
    return df.select(F.lit(src).alias("src"), clean_id(F.col("impressionId")).alias("id"), period.alias("period"), F.lit(False).alias("timed")).where("id is not null")


def _combined(table: pa.Table, keys: list[str], figures: dict[str, str]) -> pa.Table:
    out = table.group_by(keys, use_threads=False).aggregate(list(figures.items()))
    return out.select([*keys, *(f"{c}_{how}" for c, how in figures.items())]).rename_columns([*keys, *figures])


def _combine(keys: list[str], figures: dict[str, str]):
    """Rows of equal keys to one, among HELD_ROWS rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD_ROWS:
                yield from _combined(pa.Table.from_batches(held), keys, figures).to_batches()
                held, n = [], 0
        if held:
            yield from _combined(pa.Table.from_batches(held), keys, figures).to_batches()

    return run


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parents come first, sorted by hash; then each batch of references is searched for in them."""
    held: list[pa.Table] = []
    parents = keys = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        cut = int(np.searchsorted(table["kind"].to_numpy(), 1))
        if cut:
            held.append(table.slice(0, cut).select(["h", "id", "present", "first_at", "removed", "removed_at"]))
        refs = table.slice(cut)
        if not refs.num_rows:
            continue
        if keys is None:
            parents = _combined(pa.concat_tables(held), ["h", "id"], STATE).sort_by("h").combine_chunks() if held else table.slice(0, 0)
            keys, held = parents["h"].to_numpy(), []
        wanted = refs["h"].to_numpy()
        at = np.searchsorted(keys, wanted)
        found = np.full(len(wanted), -1, dtype=np.int64)
        todo = np.arange(len(wanted))
        while len(todo):  # more than one step only where hashes collide
            todo = todo[at[todo] < len(keys)]
            todo = todo[keys[at[todo]] == wanted[todo]]
            same = np.asarray(pc.equal(refs["id"].take(pa.array(todo)), parents["id"].take(pa.array(at[todo]))), dtype=bool)
            found[todo[same]] = at[todo[same]]
            todo = todo[~same]
            at[todo] += 1
        take = pa.array(np.where(found < 0, 0, found), mask=found < 0)
        own = parents.take(take)
        there = pc.fill_null(own["present"], False)
        gone = pc.fill_null(own["removed"], False)
        asof = refs["asof"]
        early = pc.fill_null(pc.less_equal(own["first_at"], asof), False)
        cut_off = pc.fill_null(pc.less_equal(own["removed_at"], asof), False)
        timed = refs["timed"]
        missing = pc.invert(there)
        withdrawn = pc.if_else(timed, cut_off, gone)
        later = pc.and_(timed, pc.invert(early))
        reason = pc.case_when(pc.make_struct(missing, withdrawn, later), pa.scalar("missing"), pa.scalar("withdrawn"), pa.scalar("later"))
        out = pa.table({"src": refs["src"], "id": refs["id"], "period": refs["period"], "reason": reason, "n_refs": refs["n_refs"]})
        yield from out.filter(pc.is_valid(reason)).to_batches()


def orphan_references(references: DataFrame, states: DataFrame, n_parents: int) -> DataFrame:
    """The references whose record is missing, withdrawn or delivered only later.

    ``references``: src, id, period, timed (see above). ``states``: from :func:`parent_states`.
    ``n_parents``: an upper bound of the number of ids, e.g. the parents' row count; it sets the
    number of ranges, so that the arrays of one range stay small. Result: src, id, period, reason
    (``missing``, ``withdrawn`` or ``later``, the first that holds), n_refs, one row per src, id and period.

    A timed reference whose period is no partition name has nothing delivered before it and is reported as ``later``
    (or ``missing``). Empty inputs give no rows; repeated references are counted in n_refs.
    """
    spark = references.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_parents // PARENTS_PER_RANGE))
    refs = references.select("src", "id", "period", "timed", F.lit(1).cast("bigint").alias("n_refs")).mapInArrow(_combine(["src", "id", "period", "timed"], {"n_refs": "sum"}), "src string, id string, period string, timed boolean, n_refs bigint")
    asked = refs.select(F.lit(1).alias("kind"), "*", F.when(F.col("timed"), slot_number(F.col("period"))).alias("asof"))
    both = states.select(F.lit(0).alias("kind"), "*").unionByName(asked, allowMissingColumns=True).withColumn("h", F.xxhash64("id"))
    at = F.shiftright((F.shiftright("h", 32) + (1 << 31)) * ranges, 32).cast("int")
    misses = both.repartitionById(ranges, at).sortWithinPartitions("kind", "h").mapInArrow(_probe, MISSES)
    return misses.groupBy("src", "id", "period", "reason").agg(F.sum("n_refs").alias("n_refs"))


def orphans_by_period(misses: DataFrame) -> DataFrame:
    """Per src, period and reason: ids and references that lead nowhere."""
    return misses.groupBy("src", "period", "reason").agg(F.count(F.lit(1)).alias("n_ids"), F.sum("n_refs").alias("n_refs"))
