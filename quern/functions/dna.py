"""Sequence expressions: normal form and strands; codes of seeds as arrays; and the edit script of k differences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BASES, COMPLEMENTS = "ACGT", "TGCA"
EXACT_SEED = 31
LONG_SEED_FACTOR = 0x9E3779B97F4A7C15  # odd, so that no base loses its weight modulo 2**64


def normal_bases(seq: Column) -> Column:
    """Upper case, anything but A, C, G, T as N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def reverse_complement(seq: Column) -> Column:
    """Of a sequence in normal form; N stays N."""
    return F.reverse(F.translate(seq, BASES, COMPLEMENTS))


def is_homopolymer(seed: Column) -> Column:
    return seed == F.repeat(F.substring(seed, 1, 1), F.length(seed))


def pack_seed(seed: Column) -> Column:
    """Up to 31 bases without N as a bigint of two bits each, so that equal length seeds join on 8 bytes."""
    return F.conv(F.translate(seed, BASES, "0123"), 4, 10).cast("bigint")


def unpack_seed(packed: Column, length: int) -> Column:
    return F.translate(F.lpad(F.conv(packed.cast("string"), 10, 4), length, "0"), "0123", BASES)


def base_codes(text: np.ndarray) -> np.ndarray:
    """0 to 3 for the bytes of A, C, G and T, 4 for others."""
    table = np.full(256, len(BASES), dtype=np.uint8)
    table[list(BASES.encode())] = np.arange(len(BASES))
    return table[text]


def seed_codes(bases: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, usable) of the ``length`` bases from each position on; usable is False where one of them is N.

    Up to 31 bases the code is their base 4 number, so different seeds have different codes; beyond, it is a
    polynomial modulo 2**64. Codes of twice as many bases are put together from two, so the work per position is log2(length).
    """
    n = len(bases) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    power = 4 if length <= EXACT_SEED else LONG_SEED_FACTOR
    block, width = bases.astype(np.uint64), 1
    code, have = np.zeros(len(bases), dtype=np.uint64), 0
    while have < length:
        if length & width:
            m = len(bases) - have - width + 1
            code, have = code[:m] * np.uint64(power) + block[have : have + m], have + width
        block = block[:-width] * np.uint64(power) + block[width:] if len(block) > width else block[:0]
        width, power = 2 * width, power * power % (1 << 64)
    unknown = np.concatenate(([0], np.cumsum(bases >= len(BASES))))
    return code.view(np.int64), unknown[length:] == unknown[:-length]


def homopolymer_codes(length: int) -> np.ndarray:
    """The codes of the seeds that repeat one base."""
    return np.array([seed_codes(np.full(length, b, dtype=np.uint8), length)[0][0] for b in range(len(BASES))])


def k_difference(ref: str, read: str, k: int) -> tuple[int, list[tuple[int, str]]] | None:
    """Align all of ``read`` to a beginning of ``ref`` with at most k differences.

    Gives the reference length used and the edits (position in the read, kind), kinds being ``mismatch``,
    ``gap`` (a reference base the read lacks) and ``extra`` (a base the reference lacks); None if there is no such alignment.
    Waves of e edits are followed along diagonals; where several edits reach equally far, a mismatch
    goes before a gap, and a gap before an extra base.
    """

    def slide(row: int, diagonal: int) -> int:
        while row < len(read) and row + diagonal < len(ref) and read[row] == ref[row + diagonal]:
            row += 1
        return row

    wave: dict[int, tuple[int, tuple]] = {0: (slide(0, 0), ())}
    for e in range(k + 1):
        done = [(d, script) for d, (row, script) in sorted(wave.items()) if row == len(read)]
        if done:
            d, script = done[0]
            return len(read) + d, list(script)
        if e == k:
            return None
        after: dict[int, tuple[int, tuple]] = {}
        for d in range(-e - 1, e + 2):
            options = [("mismatch", d, 1), ("gap", d - 1, 0), ("extra", d + 1, 1)]
            best = None
            for kind, source, step in options:
                if source not in wave:
                    continue
                at, script = wave[source]
                row = at + step
                if row > len(read) or row + d > len(ref) or (best and row <= best[0]):
                    continue
                best = (row, (*script, (at, kind)))
            if best:
                after[d] = (slide(best[0], d), best[1])
        wave = after
    return None


def script_is_leftmost(edits: list[tuple[int, str]], read_len: int, seed_len: int, unknown: list[int] | tuple = ()) -> bool:
    """The leftmost-seed test for an edit script of the flank read outwards from its far end: every chunk
    holds an edit or is one of the ``unknown``; a gap right between two chunks touches neither."""
    touched = {at // seed_len for at, kind in edits if not (kind == "gap" and at % seed_len == 0)} | set(unknown)
    return set(range(read_len // seed_len)) <= touched
