"""Seeded overlaps of all reads with all reads, by blocks of hashes and ids.

What overlap_candidates finds between the distinct sequences of one set of reads without N. Reads are
dealt by the hash of their seed, so copies meet, and of each part's seeds a filter of bits goes to all
tasks: of a read's suffixes only those whose seed may stand in a prefix are sent there, 13 bytes each.
Prefixes meet them by the hash of the whole overlap, so that reads that share no more than the seed are
never paired. Sequences, and overlaps, whose hashes of 64 bits agree are taken to be equal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from helixmill.functions.arrays import rows_of
from helixmill.operators import blocks
from helixmill.operators.blocks import DEALT, deal, dealt, gathered, hashed, mixed
from helixmill.operators.overlap import LINK
from helixmill.operators.selfmatch import CODES
from helixmill.params import ReadParams
from helixmill.plans.storage import Store

CHUNK = 1 << 14  # reads whose hashes are held at once
PAIRS = 1 << 18  # pairs of a batch
FILTER_BITS = 1 << 30  # of all filters; beyond that they let more suffixes through
_STEP = np.uint64(0x9E3779B97F4A7C15)
_OF = mixed(np.arange(1, 5)) | np.uint64(1)


def _packed(seq: np.ndarray) -> np.ndarray:
    """Rows of bases in two bits each, as opaque bytes."""
    codes = np.zeros((len(seq), -(-seq.shape[1] // 4) * 4), np.uint8)
    codes[:, : seq.shape[1]] = CODES[seq]
    out = codes[:, ::4] << 6 | codes[:, 1::4] << 4 | codes[:, 2::4] << 2 | codes[:, 3::4]
    return np.ascontiguousarray(out).view(f"V{out.shape[1]}").reshape(-1)


class _Hashes:
    """Hashes of the bases from any place to any other of packed reads."""

    def __init__(self, packed: np.ndarray, length: int):
        raw = packed.view(np.uint8).reshape(len(packed), -1)
        codes = ((raw[:, :, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).reshape(len(raw), -1)
        self.sums = np.zeros((length + 1, len(raw)), np.uint64)
        self.power = np.cumprod(np.append(np.uint64(1), np.full(length, _STEP)), dtype=np.uint64)
        for i in range(length):
            self.sums[i + 1] = self.sums[i] * _STEP + _OF[codes[:, i]]

    def of(self, i: int, j: int) -> np.ndarray:
        return mixed(self.sums[j] - self.sums[i] * self.power[j - i : j - i + 1])


def all_candidates(store: Store, reads: DataFrame, p: ReadParams) -> DataFrame:
    """(s, p, off) of the distinct sequences of ``reads``, each as its smallest id."""
    if p.max_offset > 256:
        raise ValueError(f"offsets of up to {p.max_offset - 1} bases; supported are 255")
    reads, context = reads.select("read_id", "seq"), reads.sparkSession.sparkContext
    parts, at, k = max(1, -(-reads.count() // blocks.PART_ROWS)), p.overlap_at, p.overlap_k
    most = max(10, (FILTER_BITS // parts).bit_length() - 1)
    kind = np.dtype(f"V{-(-p.length // 4)}")

    def by_seed(b: pa.RecordBatch) -> Iterator[tuple]:
        ids, packed = b.column(0).to_numpy(), _packed(rows_of(b.column(1), p.length))
        for i in range(0, len(ids), CHUNK):
            seed = _Hashes(packed[i : i + CHUNK], at + k).of(at, at + k)
            yield (seed % np.uint64(parts)).astype(np.int64), ids[i : i + CHUNK], packed[i : i + CHUNK], np.zeros(len(seed), np.uint8)

    def slots(seed: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (seed >> np.uint64(16)) & mask, (seed >> np.uint64(40)) & mask

    def distinct(table: pa.Table) -> pa.Table:
        ids, packed, _ = gathered(table, kind)
        key = hashed(packed.view(np.uint8).reshape(len(packed), -1))
        order = np.lexsort((ids, key))
        first = order[np.append(True, key[order][1:] != key[order][:-1])]
        ids, packed = ids[first], packed[first]
        bits = min(most, 24, max(10, int(16 * len(ids)).bit_length()))
        found = np.zeros(1 << bits, bool)
        cut = range(0, len(ids), CHUNK)
        for i in cut:
            for slot in slots(_Hashes(packed[i : i + CHUNK], at + k).of(at, at + k), np.uint64((1 << bits) - 1)):
                found[slot] = True
        of = lambda a: pa.array([a[i : i + CHUNK].tobytes() for i in cut], pa.binary())
        part = pa.array(np.full(len(cut), table.column("part")[0].as_py(), np.int32))
        return pa.table([part, of(ids), of(packed), pa.array([np.packbits(found).tobytes()] + [None] * (len(cut) - 1), pa.binary())], ["part", "id", "seq", "bits"])

    kept = store.save(deal(reads, by_seed).groupBy("part").applyInArrow(distinct, "part int, id binary, seq binary, bits binary"))
    filters = [np.zeros(1, np.uint8)] * parts
    masks = np.zeros(parts, np.uint64)
    for x in kept.where("bits IS NOT NULL").select("part", "bits").toLocalIterator():
        filters[x.part] = np.frombuffer(x.bits, np.uint8)
        masks[x.part] = 8 * len(x.bits) - 1
    sizes = [len(f) for f in filters]
    sent = context.broadcast((np.concatenate(filters), 8 * (np.cumsum(sizes) - sizes).astype(np.uint64), masks))
    del filters

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, start, mask = sent.value
        for b in batches:
            for part, raw, seq in zip(*(b.column(i).to_pylist() for i in range(3))):
                ids, packed, out = np.frombuffer(raw, np.int64), np.frombuffer(seq, kind), []
                yield dealt(np.full(len(ids), part), ids, packed, np.zeros(len(ids), np.uint8))
                h = _Hashes(packed, p.length)
                for off in range(1, p.max_offset):
                    seed = h.of(off + at, off + at + k)
                    to = (seed % np.uint64(parts)).astype(np.int64)
                    fine = np.ones(len(ids), bool)
                    for slot in slots(seed, mask[to]):
                        slot += start[to]
                        fine &= (bits[slot >> np.uint64(3)] << (slot & np.uint64(7)).astype(np.uint8)) & 128 != 0
                    out.append((to[fine], ids[fine], h.of(off, p.length)[fine], np.full(int(fine.sum()), off, np.uint8)))
                if out:
                    yield dealt(*map(np.concatenate, zip(*out)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for b in batches:
            t = pa.Table.from_batches([b])
            for i, (part, side) in enumerate(zip(b.column(0).to_pylist(), b.column(4).to_pylist())):
                if side:  # of a suffix its offset, of a prefix none
                    held.setdefault(part, ([], []))[side[0] > 0].append(t.slice(i, 1))
        for part in list(held):
            before, after = held.pop(part)
            if before and after:
                yield from _pairs(gathered(pa.concat_tables(before), kind), gathered(pa.concat_tables(after), np.uint64), p)

    return kept.select("part", "id", "seq").mapInArrow(rows, DEALT).repartition("part").mapInArrow(meet, LINK)


def _pairs(prefixes: tuple, suffixes: tuple, p: ReadParams) -> Iterator[pa.RecordBatch]:
    """The pairs of one part, PAIRS at a time."""
    (ids, packed, _), (s, key, off) = prefixes, suffixes
    order = np.lexsort((key, off))
    s, key, start = s[order], key[order], np.searchsorted(off[order], np.arange(p.max_offset + 1))
    for i in range(0, len(ids), CHUNK):
        h, own = _Hashes(packed[i : i + CHUNK], p.length), ids[i : i + CHUNK]
        for o in range(1, p.max_offset):
            mine, base = key[start[o] : start[o + 1]], start[o]
            if not len(mine):
                continue
            want = h.of(0, p.length - o)
            shift = np.uint64(64 - max(8, int(8 * len(mine)).bit_length()))
            near = np.zeros(1 << (64 - int(shift)), bool)
            near[mine >> shift] = True
            met = np.flatnonzero(near[want >> shift])
            lo, hi = np.searchsorted(mine, want[met]), np.searchsorted(mine, want[met], "right")
            met, lo, n = met[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            ends = np.cumsum(n)
            for first in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
                pair = np.arange(first, min(first + PAIRS, int(ends[-1])))
                row = np.searchsorted(ends, pair, "right")
                left, right = s[base + lo[row] + pair - (ends - n)[row]], own[met[row]]
                fine = left != right
                yield pa.RecordBatch.from_arrays([pa.array(left[fine]), pa.array(right[fine]), pa.array(np.full(int(fine.sum()), o, np.int32))], ["s", "p", "off"])
