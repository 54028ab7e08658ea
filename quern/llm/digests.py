"""Percentiles of very large columns by merging centroid digests, certified by a counting pass.

A digest holds centroids (mean, weight) sorted by mean. Sorted values are clustered so that a centroid
spans at most one step of the scale function k(q) = d/(2 pi) asin(2q - 1): centroids are small at the
tails and at most about d/2 of them are kept. Digests merge by clustering their centroids again, so those
of partitions and days add up. Each task folds its rows into digests batch by batch; digests of a key
are then merged in two steps, first per salt, streaming through sorted partitions, so neither rows nor
digests of a hot key pile up in one task.

The error of an estimate is not taken on trust: a second pass counts the rows below and up to each
reported value, which gives its true rank error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

COMPRESSION = 500
SALTS = 16
HELD_VALUES = 2_000_000
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)
STATED_RANK_ERROR = 0.01  # or one row, where a row is more; half a cluster's width is 0.003 at the median

DIGEST = "n bigint, low double, high double, means array<double>, weights array<double>"


def cluster(values: np.ndarray, weights: np.ndarray, compression: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of weighted values: neighbours in sorted order are merged while they fall into one step of k(q)."""
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    total = weights.sum()
    middle = (np.cumsum(weights) - weights / 2) / total
    step = np.floor(compression / (2 * np.pi) * (np.arcsin(np.clip(2 * middle - 1, -1, 1)) + np.pi / 2)).astype(np.int64)
    starts = np.flatnonzero(np.diff(step, prepend=-1))
    heavy = np.add.reduceat(weights, starts)
    # Weighted means relative to each cluster's first value, so that huge values don't overflow.
    base = np.repeat(values[starts], np.diff(np.append(starts, len(values))))
    means = values[starts] + np.add.reduceat((values - base) * (weights / np.repeat(heavy, np.diff(np.append(starts, len(values))))), starts)
    return means, heavy


def quantile(q: float, n: int, low: float, high: float, means: np.ndarray, weights: np.ndarray) -> float:
    """Value at rank q: interpolated between centroid middles, and between the extremes and the outer ones."""
    middle = np.cumsum(weights) - weights / 2
    at = np.concatenate(([0.0], middle, [float(n)]))
    return float(np.interp(q * n, at, np.concatenate(([low], means, [high]))))


def _emit(keys: list[str], rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * (len(keys) + 5)
    kinds = [*types, pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [*keys, "n", "low", "high", "means", "weights"])


def _fold(keys: list[str], compression: int):
    """(keys..., value) batches to one digest per key seen in the task; all are let go when too much is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0
        types = [pa.string()] * len(keys)

        def flush() -> pa.RecordBatch:
            rows = []
            for key, (n, low, high, parts) in held.items():
                m, w = cluster(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), compression)
                rows.append((*key, n, low, high, m, w))
            held.clear()
            return _emit(keys, rows, types)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            codes = np.zeros(table.num_rows, dtype=np.int64)
            names = []
            for k in keys:
                d = table[k].combine_chunks().dictionary_encode()
                names.append(d.dictionary.to_pylist())
                codes = codes * len(names[-1]) + d.indices.to_numpy()
            values = table["value"].to_numpy()
            order = np.lexsort((values, codes))
            codes, values = codes[order], values[order]
            starts = np.flatnonzero(np.diff(codes, prepend=-1))
            for a, b in zip(starts, np.append(starts[1:], len(codes))):
                code, key = int(codes[a]), []
                for d in reversed(names):
                    code, i = divmod(code, len(d))
                    key.append(d[i])
                v = values[a:b]
                part = cluster(v, np.ones(b - a), compression) if b - a > 2 * compression else (v, np.ones(b - a))
                own = held.setdefault(tuple(reversed(key)), [0, np.inf, -np.inf, []])
                own[0], own[1], own[2] = own[0] + int(b - a), min(own[1], float(v[0])), max(own[2], float(v[-1]))
                own[3].append(part)
                size += len(part[0])
                if len(own[3]) > 32:
                    m, w = cluster(np.concatenate([p[0] for p in own[3]]), np.concatenate([p[1] for p in own[3]]), compression)
                    size += len(m) - sum(len(p[0]) for p in own[3])
                    own[3] = [(m, w)]
            if size > HELD_VALUES:
                yield flush()
                size = 0
        yield flush()

    return run


def _merge(keys: list[str], compression: int):
    """Digests sorted by key to one per key; only the current key's centroids are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None

        def close() -> tuple:
            m, w = cluster(np.concatenate(own[3]), np.concatenate(own[4]), compression)
            return (*now, own[0], own[1], own[2], m, w)

        for batch in batches:
            rows = []
            cols = [batch.column(i).to_pylist() for i in range(len(keys) + 3)]
            means, weights = batch.column("means"), batch.column("weights")
            for i, (*key, n, low, high) in enumerate(zip(*cols)):
                if key != now:
                    if own:
                        rows.append(close())
                    now, own = key, [0, np.inf, -np.inf, [], []]
                own[0], own[1], own[2] = own[0] + n, min(own[1], low), max(own[2], high)
                own[3].append(means[i].values.to_numpy())
                own[4].append(weights[i].values.to_numpy())
                if len(own[3]) > 64:
                    m, w = cluster(np.concatenate(own[3]), np.concatenate(own[4]), compression)
                    own[3], own[4] = [m], [w]
            if rows:
                yield _emit(keys, rows, [pa.string()] * len(keys))
        yield _emit(keys, [close()] if own else [], [pa.string()] * len(keys))

    return run


def _schema(keys: list[str]) -> str:
    return ", ".join([*(f"`{k}` string" for k in keys), DIGEST])


def build_digests(values: DataFrame, keys: list[str], compression: int = COMPRESSION) -> DataFrame:
    """One digest per key of ``values`` (string keys..., value double). Rows with a null key or a value that
    is null, NaN or infinite don't count; a group without values has no digest."""
    ok = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]) & (F.abs("value") < float("inf"))
    partial = values.select(*(F.col(k).cast("string").alias(k) for k in keys), F.col("value").cast("double")).where(ok).mapInArrow(_fold(keys, compression), _schema(keys))
    salted = partial.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return _merged(_merged(salted.withColumn("salt", F.col("salt").cast("string")), ["salt", *keys], compression).drop("salt"), keys, compression)


def _merged(digests: DataFrame, keys: list[str], compression: int) -> DataFrame:
    ordered = digests.select(*keys, "n", "low", "high", "means", "weights").repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(_merge(keys, compression), _schema(keys))


def merge_digests(digests: DataFrame, keys: list[str], compression: int = COMPRESSION) -> DataFrame:
    """Digests added up to coarser keys, e.g. days of a host to the host; in two steps, as the fan-in may be large."""
    salted = digests.withColumn("salt", F.pmod(F.xxhash64("means", "n"), F.lit(SALTS)).cast("string"))
    return _merged(_merged(salted, ["salt", *keys], compression).drop("salt"), keys, compression)


def estimates(digests: DataFrame, keys: list[str], quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(keys..., n, low, high, values): the value at each of ``quantiles``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, low, high, means, weights = (b.column(c) for c in ("n", "low", "high", "means", "weights"))
            values = [[quantile(q, n[i].as_py(), low[i].as_py(), high[i].as_py(), means[i].values.to_numpy(), weights[i].values.to_numpy()) for q in quantiles] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), n, low, high, pa.array(values, pa.list_(pa.float64()))], [*keys, "n", "low", "high", "values"])

    return digests.mapInArrow(run, ", ".join([*(f"`{k}` string" for k in keys), "n bigint, low double, high double, values array<double>"]))


def certified(values: DataFrame, found: DataFrame, keys: list[str], quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(keys..., q, n, value, rank_low, rank_high, rank_error) from a second pass over ``values``.

    The share of rows below the value and up to it are its true ranks; the error is how far q lies
    outside them. How rows and estimates are joined is Spark's choice: small estimates are broadcast, so that rows
    are counted where they are; otherwise both are shuffled, and adaptive execution splits a hot key's rows among tasks.
    """
    ok = F.abs("value") < float("inf")
    rows = values.where(ok).select(*(F.col(k).cast("string").alias(k) for k in keys), F.col("value").cast("double").alias("value"))
    spread = found.select(*keys, "n", *(F.col("values")[i].alias(f"v{i}") for i in range(len(quantiles))))
    joined = rows.join(spread, keys)
    counts = []
    for i in range(len(quantiles)):
        counts += [F.sum(F.when(F.col("value") < F.col(f"v{i}"), 1).otherwise(0)).alias(f"b{i}"), F.sum(F.when(F.col("value") <= F.col(f"v{i}"), 1).otherwise(0)).alias(f"u{i}"), F.first(f"v{i}").alias(f"w{i}")]
    counted = joined.groupBy(*keys).agg(F.first("n").alias("n"), *counts)
    each = F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.col(f"w{i}").alias("value"), (F.col(f"b{i}") / F.col("n")).alias("rank_low"), (F.col(f"u{i}") / F.col("n")).alias("rank_high")) for i, q in enumerate(quantiles)))).alias("x")
    out = counted.select(*keys, "n", each).select(*keys, "n", "x.*")
    return out.withColumn("rank_error", F.greatest(F.lit(0.0), F.col("rank_low") - F.col("q"), F.col("q") - F.col("rank_high")))


def certified_percentiles(values: DataFrame, keys: list[str], quantiles: tuple[float, ...] = QUANTILES, compression: int = COMPRESSION) -> DataFrame:
    """Digests per key, their estimates and the certificate of each, in one call."""
    digests = Scratch(values.sparkSession).write(build_digests(values, keys, compression), "digests")
    return certified(values, estimates(digests, keys, quantiles), keys, quantiles)
