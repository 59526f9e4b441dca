"""Columns of the stored form: mismatches, offsets, orders, and their inverses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from helixmill.functions.arrays import COMPLEMENT, from_rows, rows_of
from helixmill.operators.ordering import previous, running_sum

BASES = ("A", "C", "G", "T")
STRETCH = 1 << 16  # positions, or rows, that one task orders


# mismatches -----------------------------------------------------------------


def _differing(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(read_id, row, off, base of the window, base of the read) of the differing places of each
    batch (read_id, strand, window, seq, ...), in the window's orientation, by row and place."""
    for b in batches:
        window, read = (rows_of(b.column(b.schema.get_field_index(c)), length) for c in ("window", "seq"))
        turned = b.column(b.schema.get_field_index("strand")).to_numpy() == 1
        read = np.where(turned[:, None], COMPLEMENT[read[:, ::-1]], read)
        row, off = np.nonzero(window != read)
        yield b.column(b.schema.get_field_index("read_id")), row, off, window[row, off], read[row, off]


def _starts(row: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` rows begins in the ascending ``row``, and the end."""
    return np.searchsorted(row, np.arange(n + 1))


def mismatch_batches(length: int) -> tuple[Callable, str]:
    """mismatch_rows of batches of alignments, and the schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, row, off, ref, read in _differing(batches, length):
            at = np.arange(len(row)) - _starts(row, len(ids))[row]
            columns = [ids.take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(off.astype(np.int32)), from_rows(ref[:, None]), from_rows(read[:, None])]
            yield pa.RecordBatch.from_arrays(columns, ["read_id", "ord", "off", "ref_base", "read_base"])

    return run, "read_id long, ord int, off int, ref_base string, read_base string"


def count_batches(length: int) -> tuple[Callable, str]:
    """Counts of (ref_base, read_base) in batches of alignments, a row for each that occurs in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 16, np.int64)
        for _, _, _, ref, read in _differing(batches, length):
            n += np.bincount(ref.astype(np.int64) << 8 | read, minlength=1 << 16)
        found = np.flatnonzero(n)
        bases = [from_rows((x & 255).astype(np.uint8)[:, None]) for x in (found >> 8, found)]
        yield pa.RecordBatch.from_arrays([*bases, pa.array(n[found])], ["ref_base", "read_base", "n"])

    return run, "ref_base string, read_base string, n long"


def code_batches(length: int) -> tuple[Callable, str]:
    """(read_id, mm, code) of batches of alignments: the offset_code of the reads with mismatches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, row, off, *_ in _differing(batches, length):
            at = _starts(row, len(ids))
            some = np.flatnonzero(np.diff(at))
            code, ends = offset_codes(off, np.append(at[some], len(off)), length)
            code = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(code.astype(np.int32)))
            columns = [ids.take(pa.array(some)), pa.array(np.diff(at)[some].astype(np.int32)), code]
            yield pa.RecordBatch.from_arrays(columns, ["read_id", "mm", "code"])

    return run, "read_id long, mm int, code array<int>"


def extract_mismatches(aligned: DataFrame, length: int) -> DataFrame:
    """``aligned`` (read_id, strand, window, seq, ...) with ``ms``: where and how the read differs
    from its window, in the window's orientation."""
    kind = T.ArrayType(T.StructType([T.StructField("off", T.IntegerType()), T.StructField("ref_base", T.StringType()), T.StructField("read_base", T.StringType())]))
    schema = T.StructType([*aligned.schema.fields, T.StructField("ms", kind)])
    at, arrow = [aligned.columns.index(c) for c in ("window", "seq", "strand")], to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            window, read = (rows_of(b.column(i), length) for i in at[:2])
            turned = b.column(at[2]).to_numpy() == 1
            read = np.where(turned[:, None], COMPLEMENT[read[:, ::-1]], read)
            row, off = np.nonzero(window != read)
            ms = pa.StructArray.from_arrays([pa.array(off.astype(np.int32)), from_rows(window[row, off][:, None]), from_rows(read[row, off][:, None])], ["off", "ref_base", "read_base"])
            ends = np.searchsorted(row, np.arange(len(window) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, ms).cast(arrow.field("ms").type)], schema=arrow)

    return aligned.mapInArrow(run, schema)


def mismatch_rows(extracted: DataFrame) -> DataFrame:
    """(read_id, ord, off, ref_base, read_base)."""
    return extracted.select("read_id", F.posexplode("ms").alias("ord", "m")).select("read_id", "ord", "m.off", "m.ref_base", "m.read_base")


def context_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ref_base", "read_base").agg(F.count("*").alias("n"))


def rank_table(rows: DataFrame) -> DataFrame:
    """(ref_base, read_base, rank): rank by frequency of the other letters for each base, ties in
    alphabetical order; 4 x 4 rows always."""
    return ranked(context_counts(rows))


def ranked(counts: DataFrame) -> DataFrame:
    """rank_table of the context_counts."""
    spark = counts.sparkSession
    every = spark.createDataFrame([(a, b) for a in BASES for b in (*BASES, "N") if a != b], "ref_base string, read_base string")
    counts = every.join(F.broadcast(counts), ["ref_base", "read_base"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counts.select("ref_base", "read_base", (F.row_number().over(Window.partitionBy("ref_base").orderBy(F.desc("n"), "read_base")) - 1).alias("rank"))


def code_bases(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with the rank of each read base; rows under an N of the reference keep none."""
    return rows.join(F.broadcast(table), ["ref_base", "read_base"], "left")


def decode_bases(coded: DataFrame, table: DataFrame) -> DataFrame:
    return coded.drop("read_base").join(F.broadcast(table), ["ref_base", "rank"])


def offset_code(offs: Column, length: int) -> Column:
    """Offsets of a read's mismatches from the nearer end: flag (1: from the right), distance of
    the first one to that end, then for two the gap less one, for more the smallest gap less one
    and each gap less the smallest, in the order walked."""
    n = F.size(offs)
    first, last = offs[0], F.element_at(offs, -1)
    right = first >= length - 1 - last
    gaps = F.zip_with(F.slice(offs, 2, n - 1), F.slice(offs, 1, n - 1), lambda b, a: b - a)
    walked = F.when(right, F.reverse(gaps)).otherwise(gaps)
    least = F.array_min(gaps)
    tail = F.when(n == 1, F.array().cast("array<int>")).when(n == 2, F.transform(gaps, lambda g: g - 1)).otherwise(F.concat(F.array(least - 1), F.transform(walked, lambda g: g - least)))
    head = F.when(right, F.array(F.lit(1), length - 1 - last)).otherwise(F.array(F.lit(0), first))
    return F.when(n > 0, F.concat(head, tail)).otherwise(F.array().cast("array<int>"))


def offset_codes(off: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """offset_code of many reads: those of read i, at least one, are off[at[i]:at[i + 1]]. The codes
    end to end, and where each begins."""
    n, start, stop = np.diff(at), at[:-1], at[1:]
    first, last = off[start], length - 1 - off[stop - 1]
    right = first >= last
    ends = np.concatenate([[0], np.cumsum(np.where(n < 3, n + 1, n + 2))])
    out = np.zeros(ends[-1], np.int64)
    out[ends[:-1]], out[ends[:-1] + 1] = right, np.where(right, last, first)
    # the gap after each offset but the last of a read
    read = np.repeat(np.arange(len(n)), n - 1)
    j = np.arange(len(read)) - np.repeat(np.cumsum(n - 1) - (n - 1), n - 1)
    gap = off[start[read] + j + 1] - off[start[read] + j]
    least = np.full(len(n), length)
    np.minimum.at(least, read, gap)
    more = n > 1
    out[ends[:-1][more] + 2] = least[more] - 1
    walked = np.where(right[read], n[read] - 2 - j, j)
    many = n[read] > 2
    out[(ends[:-1][read] + 3 + walked)[many]] = (gap - least[read])[many]
    return out, ends


def offset_decode(code: Column, n: Column, length: int) -> Column:
    """The inverse: ascending offsets of ``n`` mismatches."""
    gaps = F.when(n == 1, F.array().cast("array<int>")).when(n == 2, F.array(code[2] + 1)).otherwise(F.transform(F.slice(code, 4, F.greatest(n - 1, F.lit(0))), lambda g: g + code[2] + 1))
    sign = F.when(code[0] == 1, -1).otherwise(1)
    start = F.when(code[0] == 1, length - 1 - code[1]).otherwise(code[1])
    walked = F.aggregate(gaps, F.array(start), lambda acc, g: F.concat(acc, F.array(F.element_at(acc, -1) + sign * g)))
    return F.when(n > 0, F.when(code[0] == 1, F.reverse(walked)).otherwise(walked)).otherwise(F.array().cast("array<int>"))


def group_ordinal(df: DataFrame, width: int = 1_000_000) -> DataFrame:
    """(read_id, mm, slot): where a read's offset code begins among the codes of reads with as many
    mismatches; a code takes 2 numbers for one mismatch, 3 for two, mm + 2 for more."""
    size = F.when(F.col("mm") == 1, 2).when(F.col("mm") == 2, 3).otherwise(F.col("mm") + 2)
    return running_sum(df.where("mm > 0").select("read_id", "mm"), size, ["read_id"], width, ["mm"], "slot", exclusive=True)


# offsets ----------------------------------------------------------------------


def position_delta(df: DataFrame, by: str) -> DataFrame:
    """Distance to the previous read in (pos, read_id) order, 0 for the first."""
    rows = previous(df, "pos", ["pos", "read_id"], STRETCH, [by], "__before")
    return rows.withColumn("delta", F.coalesce(F.col("pos") - F.col("__before"), F.lit(0)).cast("long")).drop("__before")


def position_overlap(df: DataFrame, by: str, length: int) -> DataFrame:
    """Bases shared with the previous read; the first one is measured from 0."""
    rows = previous(df, "pos", ["pos", "read_id"], STRETCH, [by], "__before")
    return rows.withColumn("overlap", (length - (F.col("pos") - F.coalesce("__before", F.lit(0)))).cast("long")).drop("__before")


def positions_from_overlap(df: DataFrame, by: str, length: int) -> DataFrame:
    """The inverse of position_overlap: rows carry ``ord``, their number in the stream."""
    return running_sum(df, length - F.col("overlap"), ["ord"], STRETCH, [by], "restored")


def joined_coordinate(parts: DataFrame, sizes: DataFrame) -> DataFrame:
    """``parts`` (component, pos, ...) with ``joined``: one coordinate over components laid end to
    end; ``sizes`` holds the few components' sizes and order."""
    w = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("base", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("long")).select("component", "base")
    return parts.join(F.broadcast(base), "component").withColumn("joined", F.col("pos") + F.col("base")).drop("base")


def split_coordinate(joined: DataFrame, sizes: DataFrame) -> DataFrame:
    """The inverse: (component2, pos2) from ``joined``."""
    w = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("base", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("long")).select(F.col("component").alias("component2"), "base", "size")
    return joined.join(F.broadcast(base), (F.col("joined") >= F.col("base")) & (F.col("joined") < F.col("base") + F.col("size"))).withColumn("pos2", F.col("joined") - F.col("base")).drop("base", "size")


# pairs --------------------------------------------------------------------------


def mate_positions(placed: DataFrame) -> DataFrame:
    """(pair_id, base, other) from (read_id, pair_id, mate, pos): mate 0's position is the base."""
    return placed.groupBy("pair_id").agg(F.max(F.when(F.col("mate") == 0, F.col("pos"))).alias("base"), F.max(F.when(F.col("mate") == 1, F.col("pos"))).alias("other"))


def _folded(df: DataFrame, by: str, more: list[tuple[str, str]], step) -> DataFrame:
    """``df`` with the columns ``more``, made by a fold in order of ``ord`` over the rows of each value
    of ``by``: ``step(batch, state)`` gives the new columns of rows of one value, and the state after
    them. Rows stream past in Arrow batches; one state is held at a time."""
    types = {"long": T.LongType(), "string": T.StringType()}
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, types[t]) for n, t in more)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None
        for b in batches:
            keys = b.column(b.schema.get_field_index(by)).to_pylist()
            cut = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            for lo, hi in zip(cut[:-1], cut[1:]):
                if keys[lo] != key:
                    key, state = keys[lo], (0, 0, False)
                part = b.slice(lo, hi - lo)
                columns, state = step(part, state)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, arrow.field(n).type) for c, (n, _) in zip(columns, more))], schema=arrow)

    return df.repartition(by).sortWithinPartitions(by, "ord").mapInArrow(run, schema)


def _column(b: pa.RecordBatch, name: str) -> list:
    return b.column(b.schema.get_field_index(name)).to_pylist()


def predict(items: DataFrame, by: str, small: int, lo: int, hi: int) -> DataFrame:
    """Distances as class ``near`` (up to ``small``), ``delta`` (difference from a predictor within
    lo..hi) or ``far``; ``items`` holds (by, ord, dist) and what else is to be kept.

    The predictor starts at 0 and moves to a distance that hits; after a miss it moves too, unless
    the item before the miss had hit and left the predictor at its own distance. Near items do not
    take part. The fold runs along each value of ``by``, a block."""

    def step(b: pa.RecordBatch, state: tuple) -> tuple:
        ref, prev, match = state
        kinds, values = [], []
        for d in _column(b, "dist"):
            kind, value = "near", d
            if d > small:
                delta = d - ref
                hit = lo <= delta <= hi
                kind, value = ("delta", delta) if hit else ("far", d)
                if hit or not match or ref != prev:
                    ref = d
                prev, match = d, hit
            kinds.append(kind)
            values.append(value)
        return (kinds, values), (ref, prev, match)

    return _folded(items, by, [("kind", "string"), ("value", "long")], step)


def unpredict(coded: DataFrame, by: str) -> DataFrame:
    """The inverse: ``restored`` distances from (by, ord, kind, value)."""

    def step(b: pa.RecordBatch, state: tuple) -> tuple:
        ref, prev, match = state
        out = []
        for kind, value in zip(_column(b, "kind"), _column(b, "value")):
            d = value
            if kind != "near":
                hit = kind == "delta"
                d = ref + value if hit else value
                if hit or not match or ref != prev:
                    ref = d
                prev, match = d, hit
            out.append(d)
        return (out,), (ref, prev, match)

    return _folded(coded, by, [("restored", "long")], step)
