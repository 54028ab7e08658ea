"""Seed-and-extend alignment of short reads, its filters and statistics, and k-mer counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna
from ..sources.files import CHUNK

HELD_BASES = 1_000_000
FOUND = "read_id bigint, ref_id bigint, ref_start int, ref_end int, differences int, is_rc boolean"
EXTENDED = "struct<used_left int, used_right int, differences int>"


def chunked(seqs: DataFrame, ident: str, overlap: int, chunk: int = CHUNK) -> DataFrame:
    """(ident, chunk, offset, last_chunk, seq as bytes): sequences in chunks of ``chunk`` bases and, where there are
    more, ``overlap`` further ones, spread over all tasks. Null sequences and those without an id have none, empty ones one chunk.

    Sequences are cut as bytes, in which a piece costs its own length wherever it lies, so the work is linear in
    the length of a sequence. Every position belongs to one chunk: the one it lies in before the overlap.
    """
    rows = seqs.where(F.col("seq").isNotNull() & F.col(ident).isNotNull()).select(F.col(ident).cast("bigint").alias(ident), F.encode("seq", "UTF-8").alias("whole"))
    last = F.floor((F.octet_length("whole") - 1) / chunk)
    cut = rows.select(ident, "whole", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(last, F.lit(0).cast("bigint")))).alias("chunk"))
    offset = F.col("chunk") * chunk
    piece = F.substr("whole", (offset + 1).cast("int"), F.lit(chunk + overlap))
    return cut.select(ident, "chunk", offset.alias("offset"), (F.octet_length("whole") <= offset + chunk).alias("last_chunk"), piece.alias("seq")).repartition(ident, "chunk")


def kmers(seqs: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """(seq_id, kmer, position from 0) of every k-mer of every sequence; shorter sequences and null have none."""
    rows = chunked(seqs, "seq_id", k - 1, chunk)
    own = F.least(F.lit(chunk), F.octet_length("seq") - k + 1)
    at = rows.where(F.octet_length("seq") >= k).select("seq_id", "offset", "seq", F.explode(F.sequence(F.lit(0), own - 1)).alias("at"))
    return at.select("seq_id", F.substr("seq", F.col("at") + 1, F.lit(k)).cast("string").alias("kmer"), (F.col("offset") + F.col("at")).alias("position"))


def kmer_count(seqs: DataFrame, k: int) -> DataFrame:
    """(kmer, n)."""
    return kmers(seqs, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def kmer_places(seqs: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """(kmer, seq_id, chunk, positions): where each k-mer lies, in order; one list for every chunk of a sequence, so that none
    is longer than a chunk however frequent the k-mer is."""
    rows = kmers(seqs, k, chunk).withColumn("chunk", F.floor(F.col("position") / chunk))
    return rows.groupBy("kmer", "seq_id", "chunk").agg(F.array_sort(F.collect_list("position")).alias("positions"))


def kmer_distinct(counted: DataFrame) -> DataFrame:
    return counted.agg(F.count(F.lit(1)).alias("n_kmers"), F.sum("n").alias("n_places"))


def length_range(seqs: DataFrame) -> DataFrame:
    return seqs.agg(F.min(F.length("seq")).alias("min_len"), F.max(F.length("seq")).alias("max_len"))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a text or byte column in a row, and where each starts and the last ends."""
    column = column.cast(pa.binary())
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data else np.zeros(0, dtype=np.uint8), at - at[0]


def _each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers repeated as often as told, and 0, 1, 2, ... within each row."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about HELD_BASES bases."""
    at = np.cumsum(pc.binary_length(batch.column(column)).to_numpy()) // HELD_BASES
    starts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
    yield from (batch.slice(a, b - a) for a, b in zip(starts, starts[1:]) if b > a)


def reference_seeds(chunks: DataFrame, seed_len: int, redundancy: int, chunk: int = CHUNK) -> DataFrame:
    """(h, salt, ref_id, at) of the seed at every position, h being its code; seeds with N are left out. With a
    ``redundancy`` above 1, seeds of one repeated base, which are frequent, occur that often under different salts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = dna.homopolymer_codes(seed_len)
        for whole in batches:
            for b in _slices(whole, "seq"):
                text, start = _flat(b.column("seq"))
                code, usable = dna.seed_codes(dna.base_codes(text), seed_len)
                row, at = _each(np.clip(np.diff(start) - seed_len + 1, 0, chunk))
                place = start[row] + at
                kept = usable[place]
                row, at, h = row[kept], at[kept], code[place[kept]]
                times, salt = _each(np.where(np.isin(h, frequent), redundancy, 1))
                ref, offset = b.column("ref_id").to_numpy(), b.column("offset").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(h[times]), pa.array(salt.astype(np.int32)), pa.array(ref[row[times]]), pa.array((offset[row] + at)[times])], ["h", "salt", "ref_id", "at"])

    return chunks.select("ref_id", "offset", "seq").mapInArrow(run, "h bigint, salt int, ref_id bigint, at bigint")


def read_seeds(reads: DataFrame, seed_len: int, redundancy: int) -> DataFrame:
    """(h, salt, read_id, is_rc, i, s): seeds at i = 0, seed_len, 2 seed_len, ... of each read and of its reverse
    complement, with the strand they are of; seeds with N are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = dna.homopolymer_codes(seed_len)
        other = np.arange(256, dtype=np.uint8)
        other[list(dna.BASES.encode())] = list(dna.COMPLEMENTS.encode())
        for whole in batches:
            for b in _slices(whole, "seq"):
                text, start = _flat(b.column("seq"))
                ids = b.column("read_id").to_numpy()
                # Reversed as one text, the reads come last first, each from its end.
                back, ends = other[text[::-1]], (start[-1] - start)[::-1]
                turned = pa.Array.from_buffers(pa.string(), len(ids), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(back)])
                for is_rc, strand, begin, own, own_ids in ((False, text, start, b.column("seq"), ids), (True, back, ends, turned, ids[::-1])):
                    code, usable = dna.seed_codes(dna.base_codes(strand), seed_len)
                    row, nth = _each(np.diff(begin) // seed_len)
                    place = begin[row] + nth * seed_len
                    kept = usable[place]
                    row, nth, h = row[kept], nth[kept], code[place[kept]]
                    salt = np.where(np.isin(h, frequent), own_ids[row] % redundancy, 0)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(salt.astype(np.int32)), pa.array(own_ids[row]), pa.array(np.full(len(h), is_rc)), pa.array((nth * seed_len).astype(np.int32)), own.take(pa.array(row))], ["h", "salt", "read_id", "is_rc", "i", "s"])

    return reads.select(F.col("read_id").cast("bigint"), "seq").mapInArrow(run, "h bigint, salt int, read_id bigint, is_rc boolean, i int, s string")


def usable_reads(reads: DataFrame, min_len: int, max_len: int, k: int) -> DataFrame:
    """Reads in normal form, those without an id or bases left out; a length outside [min_len, max_len] raises, more than k Ns drop the read."""
    rows = reads.where("seq is not null and read_id is not null").select("read_id", F.explode(F.array(dna.normal_bases(F.col("seq")))).alias("seq"))
    size = F.length("seq")
    wrong = F.raise_error(F.concat(F.lit(f"read length must be {min_len} to {max_len}, is "), size.cast("string"))).cast("boolean")
    return rows.where(F.when(size.between(min_len, max_len), size - F.length(F.replace("seq", F.lit("N"), F.lit(""))) <= k).otherwise(wrong))


def _extend_udf(k: int, seed_len: int):
    @F.pandas_udf(EXTENDED)
    def extend(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for ref_left, read_left, ref_right, read_right in batches:
            rows = []
            for fl, ql, fr, qr in zip(ref_left, read_left, ref_right, read_right):
                left = dna.k_difference(fl[::-1], ql[::-1], k) if ql else (0, [])
                # The flank was followed outwards; from its far end an edit at p lies at len - p (a gap) or len - 1 - p.
                edits = [(len(ql) - at - (kind != "gap"), kind) for at, kind in left[1]] if left else []
                unknown = [i // seed_len for i, c in enumerate(ql) if c == "N"]  # such chunks never seed
                if left is None or (ql and not dna.script_is_leftmost(edits, len(ql), seed_len, unknown)):
                    rows.append((None, None, None))
                    continue
                right = dna.k_difference(fr, qr, k - len(edits)) if qr else (0, [])
                rows.append((left[0], right[0], len(edits) + len(right[1])) if right else (None, None, None))
            yield pd.DataFrame(rows, columns=["used_left", "used_right", "differences"]).astype("Int32")

    return extend


def _compare(k: int, seed_len: int):
    """Reads beside as many reference bases to the alignments among them: few enough mismatches, seen from the leftmost exact seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column("s")).to_numpy()
            for size in np.unique(sizes):
                b = batch.filter(pa.array(sizes == size))
                read, ref = (_flat(b.column(c))[0].reshape(-1, size) for c in ("s", "window"))
                differ = read != ref
                total, seed = differ.sum(axis=1), b.column("i").to_numpy() // seed_len
                exact = ~(differ | (read == ord("N")))[:, : size // seed_len * seed_len].reshape(len(differ), -1, seed_len).any(axis=2)
                kept = pa.array((total <= k) & (exact.argmax(axis=1) == seed) & exact[np.arange(len(seed)), seed])
                start = b.column("start").to_numpy()
                found = pa.RecordBatch.from_arrays([b.column("read_id"), b.column("ref_id"), pa.array(start.astype(np.int32)), pa.array((start + size).astype(np.int32)), pa.array(total.astype(np.int32)), b.column("is_rc")], ["read_id", "ref_id", "ref_start", "ref_end", "differences", "is_rc"])
                yield found.filter(kept)

    return run


def align_chunks(chunks: DataFrame, reads: DataFrame, *, k: int, min_len: int, max_len: int, mode: str = "mismatch", unique: bool = False, redundancy: int = 1, chunk: int = CHUNK) -> DataFrame:
    """:func:`align` for references in chunks of ``chunk`` bases (ref_id, chunk, offset, seq as bytes in normal form), whose overlap
    must be at least ``max_len + 2 * k``."""
    if mode not in ("mismatch", "difference"):
        raise ValueError(mode)
    seed_len = min_len // (k + 1)
    seeds = reference_seeds(chunks, seed_len, redundancy, chunk)
    pairs = seeds.join(read_seeds(usable_reads(reads, min_len, max_len, k), seed_len, redundancy), ["h", "salt"])
    # Chunks are joined back to the few pairs, so that the shuffle on seeds, by far the largest, moves no bases.
    size, slack = F.length("s"), 0 if mode == "mismatch" else k
    begin = F.greatest(F.lit(0).cast("bigint"), F.col("at") - F.col("i") - slack)
    placed = pairs.where("at >= i") if mode == "mismatch" else pairs
    placed = placed.withColumn("begin", begin).withColumn("chunk", F.floor(F.col("begin") / chunk))
    both = placed.join(chunks.select("ref_id", "chunk", "offset", "seq"), ["ref_id", "chunk"])

    def bases(start: Column, n: Column) -> Column:
        return F.substr("seq", (start - F.col("offset") + 1).cast("int"), n.cast("int"))

    if mode == "mismatch":
        beside = both.select("read_id", "ref_id", F.col("begin").alias("start"), "is_rc", "i", "s", bases(F.col("begin"), size).alias("window")).where(F.octet_length("window") == size)
        found = beside.mapInArrow(_compare(k, seed_len), FOUND)
    else:
        after = size - F.col("i") - seed_len
        same = both.where(bases(F.col("at"), F.lit(seed_len)).cast("string") == F.substr("s", F.col("i") + 1, F.lit(seed_len)))
        flanks = [bases(F.col("begin"), F.col("at") - F.col("begin")).cast("string"), F.substr("s", F.lit(1), F.col("i")), bases(F.col("at") + seed_len, after + k).cast("string"), F.substr("s", F.col("i") + seed_len + 1, after)]
        x = _extend_udf(k, seed_len)(*flanks)
        found = same.withColumn("x", x).where("x.differences is not null").select("read_id", "ref_id", (F.col("at") - F.col("x.used_left")).cast("int").alias("ref_start"), (F.col("at") + seed_len + F.col("x.used_right")).cast("int").alias("ref_end"), "x.differences", "is_rc")
        # A missing base in a run of equal ones can be seen on either side of a seed, so two seeds may tell of one alignment.
        found = found.groupBy("read_id", "ref_id", "ref_start", "ref_end", "is_rc").agg(F.min("differences").alias("differences")).select(*(x.split(" ")[0] for x in FOUND.split(", ")))
    return unique_best(found) if unique else found


def align(refs: DataFrame, reads: DataFrame, *, k: int, read_len: int | None = None, min_len: int | None = None, max_len: int | None = None, mode: str = "mismatch", unique: bool = False, redundancy: int = 1, chunk: int = CHUNK) -> DataFrame:
    """(read_id, ref_id, ref_start, ref_end, differences, is_rc): where reads lie in references with at most k differences.

    ``refs``: ref_id, seq of any length; ``reads``: read_id, seq. Mode 'mismatch' allows substitutions, 'difference' also gaps and
    extra bases. By the pigeonhole principle a read with at most k differences has a seed of min_len // (k + 1)
    bases without any; seeds are joined, flanks compared, and an alignment is kept only from its leftmost exact
    seed, so mismatch mode reports each once without a shuffle; in difference mode repeats of an alignment are put together. Positions are 0-based, the end excluded; the
    whole read must fit. N equals N in flanks and never seeds, so a read whose every exact seed holds an N isn't found. ``ref_id`` must be unique. Empty and null sequences, and those without an id, align nowhere; repeated
    reads are aligned each.
    """
    min_len, max_len = min_len or read_len, max_len or read_len
    pieces = chunked(refs.select("ref_id", dna.normal_bases(F.col("seq")).alias("seq")), "ref_id", max_len + 2 * k, chunk)
    return align_chunks(pieces, reads, k=k, min_len=min_len, max_len=max_len, mode=mode, unique=unique, redundancy=redundancy, chunk=chunk)


def unique_best(alignments: DataFrame) -> DataFrame:
    """The alignment with fewest differences of each read, if no other has as few; tied reads are dropped."""
    least = Window.partitionBy("read_id").orderBy("differences")
    first = alignments.withColumn("place", F.rank().over(least)).where("place <= 1")
    return first.withColumn("tied", F.count(F.lit(1)).over(Window.partitionBy("read_id"))).where("tied = 1").drop("place", "tied")


def alignment_stats(alignments: DataFrame) -> DataFrame:
    return alignments.agg(F.count(F.lit(1)).alias("n_alignments"), F.count_if("is_rc").alias("n_reverse"), F.count_distinct("read_id").alias("n_reads"))


def alignment_text(alignments: DataFrame) -> DataFrame:
    """Display lines: reference, start, end, read, differences and strand, tab-separated."""
    return alignments.select(F.concat_ws("\t", "ref_id", "ref_start", "ref_end", "read_id", "differences", F.when(F.col("is_rc"), "-").otherwise("+")).alias("line"))


def alignment_pictures(alignments: DataFrame, refs: DataFrame, reads: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Alignments with ``picture``: three lines, the reference bases, a bar under each that the read shares at the same place, and the
    read as aligned. Of alignments of reads no longer than a chunk."""
    pieces = chunked(refs.select("ref_id", dna.normal_bases(F.col("seq")).alias("seq")), "ref_id", chunk, chunk)
    own = reads.select(F.col("read_id").cast("bigint"), dna.normal_bases(F.col("seq")).alias("s"))
    both = alignments.withColumn("chunk", F.floor(F.col("ref_start") / chunk)).join(pieces.drop("last_chunk"), ["ref_id", "chunk"]).join(own, "read_id")
    read = F.when(F.col("is_rc"), dna.reverse_complement(F.col("s"))).otherwise(F.col("s"))
    ref = F.substr("seq", (F.col("ref_start") - F.col("offset") + 1).cast("int"), (F.col("ref_end") - F.col("ref_start")).cast("int")).cast("string")
    shown = both.select(*alignments.columns, ref.alias("ref"), read.alias("read"))
    bars = F.zip_with(F.split("ref", ""), F.split("read", ""), lambda a, b: F.when(a == b, "|").otherwise(" "))
    return shown.select(*alignments.columns, F.concat_ws("\n", "ref", F.array_join(bars, ""), "read").alias("picture"))
