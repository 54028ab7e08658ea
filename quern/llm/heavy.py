"""Most frequent items among billions: code-based identification, then an exact count.

A value's 40-bit fingerprint is ten 4-bit symbols; four check symbols of a Reed-Solomon code over
GF(16) are added, so any two codewords agree in at most nine of fourteen positions. Values are hashed
to groups, and per group and position the symbols are counted: a value with at least the threshold
makes its symbol heavy at every position. A group in which some position has no heavy symbol holds no
frequent value; where at least ten positions have exactly one, they determine the only possible
codeword, the others being erasures; the rest (two frequent values met) goes into another round with
other groups, twice as many. The candidates, at most one per group, are then counted exactly by value, and so
are all values of groups that are still open after the last round.

Counters have a fixed size per task (groups x 14 x 16), and their sums stream through the reducers,
so memory depends neither on the rows nor on the number of distinct values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUPS = 2048
DATA, CHECK = 10, 4
POSITIONS, SYMBOLS = DATA + CHECK, 16
PRIMITIVE = 0b10011  # x^4 + x + 1, a primitive polynomial of GF(16)
ROUNDS = 16
MAX_DOUBLINGS = 5


def _field() -> tuple[np.ndarray, np.ndarray]:
    """Multiplication and inverses in GF(16)."""

    def times(a: int, b: int) -> int:
        p = 0
        while b:
            p ^= a * (b & 1)
            a, b = a << 1, b >> 1
            a ^= PRIMITIVE * (a >> 4)
        return p

    mul = np.array([[times(a, b) for b in range(16)] for a in range(16)], dtype=np.uint8)
    inv = np.array([0] + [int(np.flatnonzero(mul[a] == 1)[0]) for a in range(1, 16)], dtype=np.uint8)
    return mul, inv


def _solve(mul: np.ndarray, inv: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """X with a X = b over GF(16), for an invertible square a; by elimination."""
    a, b = a.copy(), b.copy()
    n = len(a)
    for i in range(n):
        pivot = i + int(np.flatnonzero(a[i:, i])[0])
        a[[i, pivot]], b[[i, pivot]] = a[[pivot, i]], b[[pivot, i]]
        by = inv[a[i, i]]
        a[i], b[i] = mul[by, a[i]], mul[by, b[i]]
        for r in range(n):
            if r != i and a[r, i]:
                f = a[r, i]
                a[r] ^= mul[f, a[i]]
                b[r] ^= mul[f, b[i]]
    return b


def _generator(mul: np.ndarray, inv: np.ndarray) -> np.ndarray:
    """14 x 10 systematic matrix: data symbols are the values of a polynomial of degree under ten at
    points 0..9, check symbols its values at 10..13, so any ten positions determine all."""
    v = np.ones((POSITIONS, DATA), dtype=np.uint8)
    for j in range(1, DATA):
        v[:, j] = mul[v[:, j - 1], np.arange(POSITIONS)]
    return np.array([_product(mul, row, _solve(mul, inv, v[:DATA], np.eye(DATA, dtype=np.uint8))) for row in v])


def _product(mul: np.ndarray, row: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(mul[row[:, None], m], axis=0)


def _track(fields: int, groups: int):
    """(field, group, fingerprint) rows to one counter block per field and group that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, inv = _field()
        code = _generator(mul, inv)
        counts = np.zeros((fields * groups, POSITIONS * SYMBOLS), dtype=np.int64)
        for batch in batches:
            field, group, print_ = (batch.column(i).to_numpy() for i in range(3))
            at = field.astype(np.int64) * groups + group
            data = [((print_ >> (4 * j)) & 15).astype(np.uint8) for j in range(DATA)]
            for p in range(POSITIONS):
                if p < DATA:
                    symbol = data[p]
                else:
                    symbol = np.zeros(len(at), dtype=np.uint8)
                    for j in range(DATA):
                        symbol ^= mul[code[p, j]][data[j]]
                counts[:, p * SYMBOLS : (p + 1) * SYMBOLS] += np.bincount(at * SYMBOLS + symbol, minlength=fields * groups * SYMBOLS).reshape(-1, SYMBOLS)
        some = np.flatnonzero(counts[:, :SYMBOLS].any(axis=1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array((some // groups).astype(np.int32)), pa.array((some % groups).astype(np.int32)), pa.array([counts[i].tobytes() for i in some], pa.binary())], ["field", "grp", "block"])

    return run


def _decode(least: int):
    """Blocks of one task, added up per field and group, to candidates; ``print`` null where undecided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, inv = _field()
        code = _generator(mul, inv)
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for f, g, block in zip(*(batch.column(i).to_pylist() for i in range(3))):
                counts = np.frombuffer(block, dtype=np.int64)
                sums[f, g] = sums[f, g] + counts if (f, g) in sums else counts
        out = []
        for (f, g), counts in sums.items():
            heavy = counts.reshape(POSITIONS, SYMBOLS) >= least
            n = heavy.sum(axis=1)
            if not n.all():
                continue
            sure = np.flatnonzero(n == 1)
            if len(sure) < DATA:
                out.append((f, g, None))
                continue
            known = heavy.argmax(axis=1).astype(np.uint8)
            data = _solve(mul, inv, code[sure[:DATA]], known[sure[:DATA], None])[:, 0]
            word = np.array([np.bitwise_xor.reduce(mul[code[p], data]) for p in range(POSITIONS)])
            if heavy[np.arange(POSITIONS), word].all():
                out.append((f, g, sum(int(x) << (4 * j) for j, x in enumerate(data))))
        cols = list(zip(*out)) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64()))], ["field", "grp", "print"])

    return run


def frequent_items(df: DataFrame, columns: list[str], one_in: int = 200, skip: tuple[str, ...] = ("", "-"), groups: int = GROUPS, rounds: int = ROUNDS) -> DataFrame:
    """(field, item, n, share): the values of each column found in at least one of ``one_in`` of all rows.

    Values are compared exactly as they are; nulls and those in ``skip`` are no items but count as rows.
    Counts are exact: the code only identifies candidates, of which there are at most ``groups`` a column
    and round; what ``rounds`` rounds leave undecided is counted by value. An empty table has no frequent item. Ties all qualify.
    """
    spark = df.sparkSession
    total = df.count()
    least = max(1, -(-total // one_in))
    pick = F.explode(F.array(*(F.struct(F.lit(i).alias("field"), F.col(f"`{c}`").cast("string").alias("item")) for i, c in enumerate(columns)))).alias("x")
    items = df.select(pick).select("x.field", "x.item").where(F.col("item").isNotNull() & ~F.col("item").isin(*skip))

    def n_groups(k: int) -> int:
        return groups << min(k, MAX_DOUBLINGS)

    def coded(k: int) -> tuple[Column, Column]:
        """Group and fingerprint in round k; each round hashes to other groups, the fingerprint stays."""
        return F.pmod(F.xxhash64(F.lit(k), "item"), F.lit(n_groups(k))).cast("int"), F.xxhash64("item").bitwiseAND(F.lit((1 << (4 * DATA)) - 1))

    found: list[tuple[int, int]] = []
    open_groups: list[tuple[int, int, int]] = []  # (round, field, group) not decided yet, at most ``groups`` a column
    for k in range(rounds if total else 0):
        rows = items
        if k:
            last = spark.createDataFrame([(f, g) for r, f, g in open_groups if r == k - 1], "field int, was int")
            rows = items.withColumn("was", coded(k - 1)[0]).join(F.broadcast(last), ["field", "was"], "left_semi")
        group, print_ = coded(k)
        blocks = rows.select("field", group.alias("grp"), print_.alias("print")).mapInArrow(_track(len(columns), n_groups(k)), "field int, grp int, block binary")
        decided = blocks.repartition("field", "grp").mapInArrow(_decode(least), "field int, grp int, print bigint").collect()
        found += [(r.field, r.print) for r in decided if r.print is not None]
        open_groups = [(k, r.field, r.grp) for r in decided if r.print is None]
        if not open_groups:
            break
    # At most one candidate per group was decoded, so this table has a bounded size whatever the input.
    candidates = spark.createDataFrame(sorted(set(found)), "field int, print bigint")
    rows = items.withColumn("print", coded(0)[1]).join(F.broadcast(candidates), ["field", "print"], "left_semi").select("field", "item")
    if open_groups:
        last = spark.createDataFrame([(f, g) for _, f, g in open_groups], "field int, was int")
        known = items.withColumns({"print": coded(0)[1], "was": coded(open_groups[0][0])[0]})
        rows = rows.unionByName(known.join(F.broadcast(last), ["field", "was"], "left_semi").join(F.broadcast(candidates), ["field", "print"], "left_anti").select("field", "item"))
    counted = rows.groupBy("field", "item").agg(F.count(F.lit(1)).alias("n"))
    named = F.element_at(F.array(*map(F.lit, columns)), F.col("field") + 1)
    return counted.where(F.col("n") * one_in >= total).select(named.alias("field"), "item", "n", (F.col("n") / total).alias("share"))
