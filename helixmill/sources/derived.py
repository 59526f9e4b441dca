"""Reads derived from a table of documents: letters become bases, windows become reads.

Bases and windows are cut from the bytes of Arrow batches: Spark's substring walks a string
from its start, which is quadratic in the length of a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.arrays import CHANGED, COMPLEMENT, cuts, from_rows, strings, utf8

LENGTH, STEP, MATE_GAP = 100, 25, 200
#: read_id = doc_id * SPREAD + window number
SPREAD = 1_000_000
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTNCGTACGNAC"
#: The base of each letter, 0 for what is none.
BASE_OF = np.zeros(256, np.uint8)
BASE_OF[list((LETTERS + LETTERS.upper()).encode())] = list((BASES * 2).encode())
#: Bytes of an Arrow batch on its way to Python.
BATCH_BYTES = 8 << 20


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").cast("long").alias("ref_id"), "text")


def _bases(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with their bases, end to end, and where each row's begin."""
    for b in batches:
        raw, at = utf8(b.column(1))
        for i, j in cuts(at):
            found = BASE_OF[raw[at[i] : at[j]]]
            known = found != 0
            before = np.concatenate([[0], np.cumsum(known, dtype=np.int64)])
            yield b.slice(i, j - i), found[known], before[at[i : j + 1] - at[i]]


def _windows(batches: Iterator[pa.RecordBatch], length: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ref_id, number, bases) of the windows of every row, a slice at a time."""
    for b, dna, at in _bases(batches):
        n = np.maximum((np.diff(at) - length) // step + 1, 0)
        if not n.sum():
            continue
        row = np.repeat(np.arange(len(n)), n)
        number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        yield b.column(0).to_numpy()[row], number, np.lib.stride_tricks.sliding_window_view(dna, length)[at[row] + number * step]


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, dna): one base string per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, dna, at in _bases(batches):
            text = strings(dna, at)
            yield pa.RecordBatch.from_arrays([b.column(0), pc.if_else(b.column(1).is_valid(), text, pa.scalar(None, pa.string()))], ["ref_id", "dna"])

    return _documents(spark, sf_dir).mapInArrow(run, "ref_id long, dna string")


def reads(spark: SparkSession, sf_dir: str, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """(read_id, seq): windows of every document's whole base string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ref, number, window in _windows(batches, length, step):
            yield pa.RecordBatch.from_arrays([pa.array(ref * SPREAD + number), from_rows(window)], ["read_id", "seq"])

    return _documents(spark, sf_dir).mapInArrow(run, "read_id long, seq string")


def alignments(spark: SparkSession, sf_dir: str, length: int = LENGTH, step: int = STEP, then: tuple[Callable, str] | None = None) -> DataFrame:
    """Reads with known place: (read_id, ref_id, pos, strand, window, seq).

    Up to six bases of the window are changed, by read number, and every third read is
    reverse complemented after that. ``then``: a function of those batches and the schema of what
    it makes of them in the same task, so that windows and reads need not leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ref, number, window in _windows(batches, length, step):
            read_id, seq = ref * SPREAD + number, window.copy()
            for k in range(1, 7):
                row = np.flatnonzero(read_id % 7 >= k)
                at = (read_id[row] * (5 + 2 * k) + 17 * k) % length
                seq[row, at] = CHANGED[window[row, at]]
            turned = read_id % 3 == 0
            seq[turned] = COMPLEMENT[seq[turned, ::-1]]
            columns = [pa.array(read_id), pa.array(ref), pa.array(number * step), pa.array(turned.astype(np.int32)), from_rows(window), from_rows(seq)]
            yield pa.RecordBatch.from_arrays(columns, ["read_id", "ref_id", "pos", "strand", "window", "seq"])

    if then:
        through, kind = then
        return _documents(spark, sf_dir).mapInArrow(lambda batches: through(run(batches)), kind)
    return _documents(spark, sf_dir).mapInArrow(run, "read_id long, ref_id long, pos long, strand int, window string, seq string")


def pairs(spark: SparkSession, sf_dir: str, length: int = LENGTH, step: int = STEP, gap: int = MATE_GAP) -> DataFrame:
    """(read_id, pair_id, mate, seq): mate 0 is a window, mate 1 the reverse complement of the
    window ``gap`` bases on; read_id = 2 * pair_id + mate."""
    from helixmill.functions.sequence import reverse_complement

    r = references(spark, sf_dir).where(F.length("dna") >= length + gap)
    r = r.select("ref_id", "dna", F.explode(F.sequence(F.lit(0), F.length("dna") - length - gap, F.lit(step))).alias("off"))
    pair = (F.col("ref_id") * SPREAD + F.floor(F.col("off") / step)).cast("long")
    one = r.select(pair.alias("pair_id"), F.lit(0).alias("mate"), F.substring("dna", F.col("off") + 1, F.lit(length)).alias("seq"))
    two = r.select(pair.alias("pair_id"), F.lit(1).alias("mate"), reverse_complement(F.substring("dna", F.col("off") + gap + 1, F.lit(length))).alias("seq"))
    return one.union(two).select((F.col("pair_id") * 2 + F.col("mate")).alias("read_id"), "pair_id", "mate", "seq")
