"""Rank-zip of all reads with all reads, at several offsets, by blocks of hashes and ids.

What zip_ends and rank_zip link between the suffixes and the prefixes of one set of reads: the i-th
suffix of a key with the i-th prefix of as many bases, prefixes shifted by one where a read would meet
itself. Overlaps whose hashes of 64 bits agree are taken to be equal. A key with many of a task's reads
goes to rank_zip; overlaps of ``SHORT`` bases and less, of few keys, are numbered over ranges of ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from helixmill.functions.arrays import rows_of
from helixmill.operators import blocks
from helixmill.operators.blocks import deal, gathered, hashed
from helixmill.operators.ordering import union_all
from helixmill.operators.overlap import COMMON, LINK, rank_zip
from helixmill.params import ReadParams
from helixmill.plans.storage import Store

SHORT = 2  # bases whose keys are numbered
SAMPLE = 4096  # one id in so many goes to the driver, for borders of ranges
CHUNK = 1 << 20  # reads among which common keys are looked for
_CODE = np.zeros(256, np.uint64)
_CODE[list(b"ACGTN")] = range(5)


def zip_all(store: Store, reads: DataFrame, offs: list[int], p: ReadParams, width: int = 1_000_000, common: int = COMMON) -> DataFrame:
    """(s, p, off) of ``reads`` with themselves at each of ``offs``."""
    reads = reads.select("read_id", "seq")
    long_offs = [o for o in offs if p.length - o > SHORT]
    n, borders, often = _survey(reads, long_offs, p, common)
    parts = max(1, -(-2 * n // blocks.PART_ROWS))
    out = [_zip_long(reads, long_offs, p, parts, often)] if long_offs else []
    for i, off in enumerate(long_offs):
        if len(often[i]):
            suffixes, prefixes = (_holding(reads, often[i], off, p, side) for side in (0, 1))
            out.append(rank_zip(suffixes, prefixes, off, p, width))
    out += [_zip_short(store, reads, off, p, n, borders) for off in offs if off not in long_offs]
    return union_all(out)


def _ends(b: pa.RecordBatch, off: int, p: ReadParams) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the suffixes and of the prefixes of a batch of reads."""
    seq = rows_of(b.column(1), p.length)
    return hashed(seq[:, off:]), hashed(seq[:, : p.length - off])


def _survey(reads: DataFrame, offs: list[int], p: ReadParams, common: int) -> tuple[int, np.ndarray, list[np.ndarray]]:
    """Number of reads, a sample of ids in order, and for each offset the keys that ``common`` ends of a chunk share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, ids = [[] for _ in offs], 0, []

        def often() -> Iterator[tuple[int, int]]:
            for i, keys in enumerate(held):
                if keys:
                    found, times = np.unique(np.concatenate(keys), return_counts=True)
                    yield from ((i, int(k)) for k in found[times >= common].view(np.int64))
                    keys.clear()

        rows, since = [], 0
        for b in batches:
            ids.append(b.column(0).to_numpy()[(-n) % SAMPLE :: SAMPLE])
            n, since = n + b.num_rows, since + b.num_rows
            for keys, off in zip(held, offs):
                keys += _ends(b, off, p)
            if since >= CHUNK:
                rows += often()
                since = 0
        rows += [*often(), *((-1, int(x)) for x in np.concatenate(ids))] if ids else []
        rows.append((-2, n))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.int64())], ["kind", "value"])

    found = reads.mapInArrow(run, "kind int, value long").collect()
    of = lambda kind: np.array([x.value for x in found if x.kind == kind], np.int64)
    return int(of(-2).sum()), np.sort(of(-1)), [np.unique(of(i).view(np.uint64)) for i in range(len(offs))]


def _holding(reads: DataFrame, keys: np.ndarray, off: int, p: ReadParams, side: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(np.isin(_ends(b, off, p)[side], keys)))

    return reads.mapInArrow(run, reads.schema)


def _zip_long(reads: DataFrame, offs: list[int], p: ReadParams, parts: int, often: list[np.ndarray]) -> DataFrame:
    def rows(b: pa.RecordBatch) -> Iterator[tuple]:
        ids = b.column(0).to_numpy()
        for i, off in enumerate(offs):
            for side, key in enumerate(_ends(b, off, p)):
                fine = ~np.isin(key, often[i]) if len(often[i]) else np.ones(len(key), bool)
                yield i * parts + (key[fine] % np.uint64(parts)).astype(np.int64), ids[fine], key[fine], np.full(int(fine.sum()), side, np.uint8)

    def links(table: pa.Table) -> pa.Table:
        off = offs[table.column("part")[0].as_py() // parts]
        return _linked(*_zipped(*gathered(table, np.uint64)), off)

    return deal(reads, rows).groupBy("part").applyInArrow(links, LINK)


def _linked(s: np.ndarray, p: np.ndarray, off: int) -> pa.Table:
    return pa.table([pa.array(s), pa.array(p), pa.array(np.full(len(s), off, np.int32))], ["s", "p", "off"])


def _zipped(ids: np.ndarray, key: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, side, key))
    ids, key, side = ids[order], key[order], side[order]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    n_s = np.bincount(group, side == 0, len(first)).astype(np.int64)
    n_p, first_p = np.diff(np.append(first, len(key))) - n_s, first + n_s
    s = np.flatnonzero(side == 0)
    s = s[s - first[group[s]] < n_p[group[s]]]
    g, rank = group[s], s - first[group[s]]
    clash = np.zeros(len(first), bool)
    clash[g[ids[s] == ids[first_p[g] + rank]]] = True
    partner = first_p[g] + np.where(clash[g], (rank - 1) % np.maximum(n_p[g], 1), rank)
    fine = ids[s] != ids[partner]
    return ids[s[fine]], ids[partner[fine]]


def _zip_short(store: Store, reads: DataFrame, off: int, p: ReadParams, n: int, borders: np.ndarray) -> DataFrame:
    """Reads in ranges of ids, each with its ranks there; the counts of the ranges before, a few
    numbers a range, make them ranks of all; blocks of ranks meet. A read meets itself where its own
    two ranks and keys agree."""
    size, block = p.length - off, blocks.PART_ROWS
    keys, parts = 5**size, max(1, -(-n // block))
    borders = np.unique(borders[np.arange(1, parts) * len(borders) // parts]) if len(borders) else borders

    def code(seq: np.ndarray) -> np.ndarray:
        out = np.zeros(len(seq), np.uint64)
        for column in seq.T:
            out = out * np.uint64(5) + _CODE[column]
        return out

    def rows(b: pa.RecordBatch) -> Iterator[tuple]:
        ids, seq = b.column(0).to_numpy(), rows_of(b.column(1), p.length)
        key = code(seq[:, off:]) | code(seq[:, :size]) << np.uint64(32)
        yield np.searchsorted(borders, ids, "right"), ids, key, np.zeros(len(ids), np.uint8)

    def ends(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (key & np.uint64((1 << 32) - 1)).astype(np.int64), (key >> np.uint64(32)).astype(np.int64)

    def ordered(table: pa.Table) -> pa.Table:
        ids, key, _ = gathered(table, np.uint64)
        order = np.argsort(ids)
        counts = np.concatenate([np.bincount(e, minlength=keys) for e in ends(key)]).astype(np.int64)
        return pa.table([table.column("part")[:1], pa.array([ids[order].tobytes()]), pa.array([key[order].tobytes()]), pa.array([counts.tobytes()])], ["part", "id", "key", "counts"])

    kept = store.save(deal(reads, rows).groupBy("part").applyInArrow(ordered, "part int, id binary, key binary, counts binary"))
    counts = np.zeros((len(borders) + 1, 2, keys), np.int64)
    for x in kept.select("part", "counts").collect():
        counts[x.part] = np.frombuffer(x.counts, np.int64).reshape(2, keys)
    before, n_p = np.cumsum(counts, 0) - counts, counts.sum(0)[1]

    def numbered(b: pa.RecordBatch) -> Iterator[tuple]:
        """ids, key and rank of all on each side, of one range."""
        for part, i, k in zip(*(b.column(j).to_pylist() for j in range(3))):
            both = []
            for side, key in enumerate(ends(np.frombuffer(k, np.uint64))):
                order = np.argsort(key, kind="stable")
                start = np.cumsum(counts[part, side]) - counts[part, side]
                rank = np.empty(len(key), np.int64)
                rank[order] = np.arange(len(key)) - start[key[order]]
                both.append((key, rank + before[part, side][key]))
            yield np.frombuffer(i, np.int64), both

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, ((ks, rs), (kp, rp)) in numbered(b):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(ks[(ks == kp) & (rs == rp)]))], ["key"])

    clash = np.zeros(keys, bool)
    clash[[x.key for x in kept.select("part", "id", "key").mapInArrow(meeting, "key long").distinct().collect()]] = True
    spread = 1 + int(counts.sum(0).max()) // block

    def shifted(b: pa.RecordBatch) -> Iterator[tuple]:
        for ids, both in numbered(b):
            for side, (key, rank) in enumerate(both):
                if side:
                    rank = np.where(clash[key], (rank + 1) % np.maximum(n_p[key], 1), rank)
                yield key * spread + rank // block, ids, rank.astype(np.uint64), np.full(len(ids), side, np.uint8)

    def links(table: pa.Table) -> pa.Table:
        ids, rank, side = gathered(table, np.uint64)
        at = (rank % np.uint64(block)).astype(np.int64)
        met = np.full((2, block), -1, np.int64)
        met[side, at] = np.arange(len(ids))
        s, q = met[:, (met >= 0).all(0)]
        fine = ids[s] != ids[q]
        return _linked(ids[s[fine]], ids[q[fine]], off)

    return deal(kept.select("part", "id", "key"), shifted).groupBy("part").applyInArrow(links, LINK)
