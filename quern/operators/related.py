"""Item-to-item similarity: postings, sampled pairs, scores and top related items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import hash_uniform, log_scale, pearson, sample_probability, similarity_score
from ..scratch import Scratch

# Ratings of a user in one block, and pairs that a task adds up at a time.
BLOCK = 1024
HELD_PAIRS = 2_000_000
SUMS = ("sxx", "sx", "sxy", "sy", "syy")


def item_counts(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("item").agg(F.count(F.lit(1)).alias("item_count"))


def user_counts(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("user").agg(F.count(F.lit(1)).alias("user_count"))


def scaled(ratings: DataFrame, scale: str, duplicates: str) -> DataFrame:
    """(user, item, rating): ``duplicates`` 'sum' adds up repeated (user, item) rows, 'pairwise' keeps them;
    scale 'log' or 'real'. Rows with a null are left out, as are ratings below 1 on the log scale."""
    rows = ratings.select("user", "item", "rating").dropna()
    if duplicates == "sum":
        rows = rows.groupBy("user", "item").agg(F.sum("rating").alias("rating"))
    return rows.withColumn("rating", log_scale(F.col("rating"))).dropna() if scale == "log" else rows


def user_postings(ratings: DataFrame, block: int = BLOCK) -> DataFrame:
    """(user, block, n, total, postings): each user's number and sum of ratings, and the ratings as arrays ordered by item as text. A
    user with more than ``block`` ratings has several arrays, among which items are spread by a hash, so none grows with the table."""
    entry = F.struct(F.col("item").cast("string").alias("item"), "rating")
    per = ratings.groupBy("user").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("total"))
    own = F.pmod(F.xxhash64("item", "rating"), F.ceil(F.col("n") / block)).cast("int")
    return ratings.join(per, "user").groupBy("user", own.alias("block"), "n", "total").agg(F.array_sort(F.collect_list(entry)).alias("postings"))


def sampled(rows: DataFrame, cutoff: float, seed: int) -> DataFrame:
    """Ratings kept with probability max(cutoff / user's ratings, cutoff / item's ratings), by a hash of user and item."""
    counted = rows.join(user_counts(rows), "user").join(item_counts(rows), "item")
    kept = hash_uniform(seed, F.col("user"), F.col("item")) < sample_probability(cutoff, F.col("user_count"), F.col("item_count"))
    return counted.where(kept).select("user", "item", "rating")


def _sums_of_pairs(held_pairs: int):
    """Rows (user, ci, cj, side, item, rating) sorted by the first four to partial sums of item pairs, ordered as text."""

    def summed(table: pa.Table) -> pa.RecordBatch:
        ends = np.flatnonzero(np.concatenate((_changes(table, ("user", "ci", "cj")), [True])))
        starts = np.concatenate(([0], ends[:-1]))
        side = table["side"].to_numpy()
        group = np.repeat(np.arange(len(starts)), ends - starts)
        at = np.arange(table.num_rows)
        # In a cell of one block a row meets those after it; in one of two blocks, those of the other block.
        begin = np.where(side == 0, starts[group] + np.bincount(group, side == 0, len(starts)).astype(np.int64)[group], ends[group])
        begin = np.where((table["ci"].to_numpy() == table["cj"].to_numpy()), at + 1, begin)
        meets = ends[group] - begin
        left = np.repeat(at, meets)
        right = np.arange(len(left)) - np.repeat(np.cumsum(meets) - meets, meets) + begin[left]
        coded = table["item"].combine_chunks().dictionary_encode()
        names = coded.dictionary
        rank = np.empty(len(names), dtype=np.int64)
        rank[np.argsort(np.array(names.cast(pa.string()).to_pylist(), dtype=object), kind="stable")] = np.arange(len(names))
        item, rating = rank[coded.indices.to_numpy()], table["rating"].to_numpy().astype(np.float64)
        turned = (item[left] > item[right]) | ((item[left] == item[right]) & (rating[left] > rating[right]))
        left, right = np.where(turned, right, left), np.where(turned, left, right)
        key = item[left] * len(names) + item[right]
        order = np.argsort(key)
        key, x, y = key[order], rating[left[order]], rating[right[order]]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        by_rank = pa.array(np.argsort(rank))
        p, q = (names.take(by_rank.take(pa.array(k))) for k in np.divmod(key[first], len(names)))
        sums = [np.add.reduceat(v, first) if len(first) else v for v in (x * x, x, x * y, y, y * y)]
        return pa.RecordBatch.from_arrays([p, q, pa.array(np.diff(np.append(first, len(key)))), *map(pa.array, sums)], ["p", "q", "n", "sxx", "sx", "sxy", "sy", "syy"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        pairs = 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held:
                table = pa.concat_tables([held.pop(), table])
            ends = np.flatnonzero(_changes(table, ("user", "ci", "cj")))
            if not len(ends):
                held.append(table)
                continue
            sizes = np.diff(ends, prepend=0)
            pairs += int((sizes * sizes).sum()) // 2
            held += [table.slice(0, ends[-1]), table.slice(ends[-1])]
            if pairs > held_pairs:
                rest = held.pop()
                yield summed(pa.concat_tables(held))
                held, pairs = [rest], 0
        if held:
            yield summed(pa.concat_tables(held))

    return run


def _changes(table: pa.Table, columns: tuple[str, ...]) -> np.ndarray:
    """Whether each row differs from the one before it; the first row doesn't."""
    out = np.zeros(table.num_rows, dtype=bool)
    for c in columns:
        v = table[c].combine_chunks()
        if len(v):
            out[1:] |= pc.not_equal(v.slice(1), v.slice(0, len(v) - 1)).to_numpy(zero_copy_only=False)
    return out


def pair_sums(rows: DataFrame) -> DataFrame:
    """(item_x, item_y, n, sums) over all users who rated both, x before y as text; of a user who rated an item several times, also
    of each two of these. Rows must not hold nulls.

    A user's ratings meet in cells of at most two blocks of BLOCK ratings: one cell for most users; the ratings of
    a prolific one are dealt to b blocks and copied b times, a cell for each pair of blocks, so they spread over tasks. Tasks
    add up the pairs of many cells before they are shuffled.
    """
    hot = user_counts(rows).where(F.col("user_count") > BLOCK).select("user", F.ceil(F.col("user_count") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(hot, "user", "left").select("user", "item", "rating", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("item", "rating"), F.col("blocks")).cast("int"))
    cells = dealt.select("user", "item", "rating", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = cells.select("user", F.least("block", "other").alias("ci"), F.greatest("block", "other").alias("cj"), (F.col("block") > F.col("other")).cast("int").alias("side"), "item", "rating")
    schema = T.StructType([T.StructField("p", rows.schema["item"].dataType), T.StructField("q", rows.schema["item"].dataType), T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in SUMS)])
    partial = placed.repartition("user", "ci", "cj").sortWithinPartitions("user", "ci", "cj", "side").mapInArrow(_sums_of_pairs(HELD_PAIRS), schema)
    sums = partial.groupBy("p", "q").agg(*(F.sum(c).alias(c) for c in ("n", *SUMS)))
    return sums.select(F.col("p").cast("string").alias("item_x"), F.col("q").cast("string").alias("item_y"), "n", *SUMS)


def item_similarity(ratings: DataFrame, *, scale: str = "log", cutoff: float | None, n_users: int, seed: int = 42, duplicates: str = "sum") -> DataFrame:
    """(item_x, item_y, sim, n), each pair once. Without a cutoff, or with one of at least every user's or item's count, nothing is sampled."""
    # Counts and pairs read the ratings, so what is scaled, and what is sampled of it, is made once.
    scratch = Scratch(ratings.sparkSession)
    rows = scratch.write(scaled(ratings, scale, duplicates), "ratings")
    sums = pair_sums(rows if cutoff is None else scratch.write(sampled(rows, cutoff, seed), "sampled"))
    r = pearson(*(F.col(c) for c in ("sxx", "sx", "sxy", "sy", "syy", "n")))
    return sums.select("item_x", "item_y", similarity_score(r, F.col("n"), n_users).alias("sim"), "n")


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair in both directions, read once."""
    ways = F.explode(F.array(F.struct("item_x", "item_y"), F.struct(F.col("item_y").alias("item_x"), F.col("item_x").alias("item_y")))).alias("w")
    return pairs.select(ways, "sim", "n").select("w.item_x", "w.item_y", "sim", "n")


def related_items(pairs: DataFrame, names: DataFrame | None = None, *, min_coratings: int, k: int = 25) -> DataFrame:
    """(item_x, item_y, sim, n, name): for every item with a similar one, itself (1.0, 0) and its k most similar, ties by item.

    ``names``: (item, name); an item without a name has null there.
    """
    kept = both_ways(pairs).where(F.col("n") >= min_coratings)
    order = Window.partitionBy("item_x").orderBy(F.desc("sim"), "item_y")
    best = kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    # The best one of each item also brings the item's own row.
    own = F.struct(F.col("item_x").alias("item_y"), F.lit(1.0).alias("sim"), F.lit(0).cast("bigint").alias("n"))
    other = F.struct("item_y", F.round("sim", 4).alias("sim"), "n")
    rows = best.select("item_x", F.explode(F.when(F.col("place") == 1, F.array(own, other)).otherwise(F.array(other))).alias("w")).select("item_x", "w.*")
    if names is None:
        return rows.withColumn("name", F.lit(None).cast("string"))
    return rows.join(names.select(F.col("item").cast("string").alias("item_y"), "name"), "item_y", "left").select("item_x", "item_y", "sim", "n", "name")
