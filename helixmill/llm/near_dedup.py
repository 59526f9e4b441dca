"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set is its distinct ``WIDTH``-word shingles (words are runs of
non-space characters, A-Z lower-cased). Documents with one and the same set
form a class at once; the rest works on one document per class, whose sketch is
the ``KEEP`` smallest hash values of its set:

1. Inverted lists. Each sketch is walked from its smallest value on. A value that more
   than ``LONG`` documents list is hot (a passage that many share) and is passed over;
   the others are listed until there are ``LISTED`` more of them than hot ones were
   passed. Sets of similarity 0.8 then share no list with probability 1e-7 without hot
   values, 1e-6 at most with them, and one list only with 6e-6. Which values are hot
   is found in rounds, until none is added, and is the same for all documents.
2. A document whose sketch ends before that and is hot by ``DENSE`` or more lists its
   ``LISTED`` smallest hot values too: two such sets may share nothing else.
3. Overlaps. Members of a list of up to ``LONG`` meet inside one task, which
   compares sketches and emits only pairs that pass, and of surely linked ones no
   more than it takes to join their components. Where the exact check refuses such a
   pair, its list meets anew without that shortcut.
4. Members of a longer list first meet its hub, the member whose lists are longest:
   a group of near copies becomes one component this way without pairs among them.
   What is then still between components meets block by block: the members outside
   the largest component with all others where those are few, else each block with
   each other.
5. Where that is more than ``CROSS`` pairs a member, the members are listed anew by
   tuples of retained values; ``LEVELS`` gives tuple size and number of tuples. A list
   that stays open at the last level is compared block by block, so nothing is dropped.
6. The union of both sketches estimates the similarity, without error for sets of
   up to ``KEEP`` shingles; pairs more than ``SIGMAS`` standard deviations under the
   threshold are let go.
7. Exact Jaccard on the full shingle sets, from the texts, confirms each link.

Components are found by alternating large-star and small-star steps on tables in
the shared folder, or in one task where there are ``EDGES`` links at most.

Cases: null or blank text has an empty set, links with nothing and stands alone;
fewer than WIDTH words are one shingle; equal documents are linked; rows that
repeat a doc_id get one row each in the result, with the same component; rows
with null doc_id take no part, they keep component_id null and kept true; extra
columns are not read; a very long text is one row of the text slices and its set is
held by one task at a time; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from helixmill.llm import grams as G
from helixmill.llm.common import Scratch, sheltered, slices, utf8

WIDTH, SHARE = 4, 80  # words of a shingle; percent
LISTED, KEEP = 10, 256  # values in lists; values of a sketch
DENSE = 0.65  # share of hot values from which a sketch that ran out lists hot ones too
AHEAD = 4  # how much further documents that met hot values are walked in search of more
HOT_SHIFT = 20  # with over LONG << HOT_SHIFT listed values, hot begins at that part of them: the hot values stay few
BINS = 64
LEVELS = [(4, 40), (8, 400)]  # a pair of similarity 0.8 shares no tuple with probability 1e-5, 5e-6
SIGMAS = 4.2
LONG = 1500  # members of a list that meet in one task
CROSS = 10_000  # pairs between components a member that are cheaper to compare than tuples to deal, counted twice
BLOCK = 512  # members of a longer list in one task, with as many others
CHUNK = 400_000  # shingles of the texts verified together
EDGES = 1 << 20  # links whose components one task finds, in some 100 MB
SLOTS = 1 << 24  # bits of the table of documents that a verification needs
_PAD = np.uint32(0xFFFFFFFF)


def sets(raw: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    w = G.words(raw, at, G.NOT_SPACE)
    g = G.grams(w.hashes, width)
    out = []
    for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if hi - lo >= width:
            h = np.sort(g[lo : hi - width + 1])
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
        else:
            out.append(G.grams(w.hashes[lo:hi], hi - lo) if hi > lo else np.zeros(0, G.U))
    return out


def sketch(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n, fp, kept, rest): set size, set identity, upper and lower halves of the sketch's values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = sets(*utf8(b.column(1)), width)
            yield pa.RecordBatch.from_arrays([
                b.column(0).cast(pa.int64()),
                pa.array([len(x) for x in found], pa.int64()),
                pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in found], pa.binary()),
                pa.array([(x[:KEEP] >> G.U(32)).astype(np.uint32).tobytes() for x in found], pa.binary()),
                pa.array([x[:KEEP].astype(np.uint32).tobytes() for x in found], pa.binary()),
            ], ["doc_id", "n", "fp", "kept", "rest"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, fp binary, kept binary, rest binary")


def walk(values: np.ndarray, at: np.ndarray, hot: np.ndarray, factor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, value, kind) of what is listed of sketches laid end to end, document i's
    from at[i] on; ``hot`` is sorted. Kind 0: of a document that met no hot value, 1: of one
    that did, 2: a hot value of a dense one. ``factor`` looks further in search of hot values."""
    size = np.diff(at)
    own = np.repeat(np.arange(len(size)), size)
    is_hot = hot[np.minimum(np.searchsorted(hot, values), len(hot) - 1)] == values if len(hot) else np.zeros(len(values), bool)
    met = np.concatenate(([0], np.cumsum(is_hot)))
    before = met[at[:-1]][own]
    hot_so_far = met[1:] - before
    place = np.arange(len(values)) - at[:-1][own]  # from 0
    cold_so_far = place + 1 - hot_so_far
    enough = cold_so_far >= np.where(hot_so_far > 0, factor * (LISTED + hot_so_far), LISTED)
    ends = np.full(len(size), KEEP)
    np.minimum.at(ends, own[enough], place[enough])
    mine = ends[own]
    seen = np.bincount(own[is_hot & (place <= mine)], minlength=len(size))
    every = met[at[1:]] - met[at[:-1]]
    dense = (ends == KEEP) & (every > 0) & (every >= DENSE * size)
    cold = ~is_hot & (place <= mine)
    some = is_hot & dense[own] & (hot_so_far <= LISTED)
    doc = np.concatenate((own[cold], own[some]))
    kind = np.concatenate(((seen[own[cold]] > 0).astype(np.int32), np.full(int(some.sum()), 2, np.int32)))
    return doc, np.concatenate((values[cold], values[some])), kind


def _walked(sent, factor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 2000):
                x = big.slice(lo, 2000)
                high, low = (c.to_pylist() for c in (x.column(2), x.column(3)))
                at = np.concatenate(([0], np.cumsum([len(h) // 4 for h in high])))
                v = (np.frombuffer(b"".join(high), np.uint32).astype(G.U) << G.U(32)) | np.frombuffer(b"".join(low), np.uint32).astype(G.U)
                doc, value, kind = walk(v, at, sent.value, factor)
                doc = pa.array(doc)
                yield pa.RecordBatch.from_arrays([x.column(0).take(doc), x.column(1).take(doc), pa.array(value.view(np.int64)), pa.array(kind)], ["rep", "n", "key", "kind"])

    return run


def listed(scratch: Scratch, reps: DataFrame) -> DataFrame:
    """(rep, n, key, kind) of all lists; ``reps`` holds (rep, n, kept, rest).

    The hot values go out to all tasks: fewer than KEEP / LISTED * 2 ** HOT_SHIFT of them
    exist, as each is listed more than reps * LISTED / 2 ** HOT_SHIFT times."""
    spark = scratch.spark
    least = max(LONG, reps.count() * LISTED >> HOT_SHIFT)
    rows, hot = reps.select("rep", "n", "kept", "rest"), np.zeros(0, G.U)
    schema = "rep long, n long, key long, kind int"
    while True:
        sent = spark.sparkContext.broadcast(hot)
        often = rows.mapInArrow(_walked(sent, AHEAD), schema).where("kind < 2").groupBy("key").agg(F.count("*").alias("m"))
        more = often.where(F.col("m") > least).select("key").toPandas()["key"].to_numpy(np.int64).view(G.U)
        if not len(more):
            break
        hot = np.union1d(hot, more)
    return scratch.save(rows.mapInArrow(_walked(sent, 1), schema), "listed")


def _matrix(kept: list[bytes]) -> np.ndarray:
    out = np.full((len(kept), KEEP), _PAD)
    for i, x in enumerate(kept):
        v = np.frombuffer(x, np.uint32)
        out[i, : len(v)] = v
    return out


def bins(m: np.ndarray) -> np.ndarray:
    """Smallest retained value of each of BINS parts of the hash space, by low bits."""
    part = (m & np.uint32(BINS - 1)).astype(np.int64)
    out = np.full((len(m), BINS), _PAD)
    rows = np.repeat(np.arange(len(m)), KEEP)
    np.minimum.at(out, (rows, part.ravel()), m.ravel())
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(similarity by the union sketch, its standard deviation) of each row of a and b."""
    last = _PAD - np.uint32(1)
    whole = (a[:, -1] == _PAD) & (b[:, -1] == _PAD)
    bound = np.minimum(np.where(a[:, -1] == _PAD, last, a[:, -1]), np.where(b[:, -1] == _PAD, last, b[:, -1]))
    s = np.sort(np.concatenate([a, b], axis=1), axis=1)
    within = s <= bound[:, None]
    both = ((s[:, 1:] == s[:, :-1]) & within[:, 1:]).sum(axis=1)
    k = np.maximum(within.sum(axis=1) - both, 1)
    return both / k, np.where(whole, 0.0, 0.4 / np.sqrt(k))


class Row:
    """Estimates of one sketch against many, by a table of its values' low bits."""

    def __init__(self, m: np.ndarray, n: np.ndarray):
        self.m, self.n, self.table = m, n, np.zeros(1 << 20, bool)
        self.low = (m & np.uint32((1 << 20) - 1)).astype(np.int32)
        self.size = np.minimum(n, KEEP)
        self.bound = np.where(n >= KEEP, m[:, -1], _PAD - np.uint32(1))

    def estimate(self, i: int, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.low[i, : self.size[i]]
        self.table[own] = True
        real = self.m[j] != _PAD
        both = (self.table[self.low[j]] & real).sum(axis=1)
        self.table[own] = False
        bound = np.minimum(self.bound[i], self.bound[j])
        mine = np.searchsorted(self.m[i, : self.size[i]], bound, "right")
        k = np.maximum(mine + (self.m[j] <= bound[:, None]).sum(axis=1) - both, 1)
        share = np.minimum(both / k, 1.0)
        union = (self.n[i] + self.n[j]) / (1 + share)
        whole = (self.n[i] <= KEEP) & (self.n[j] <= KEEP)
        return share, np.where(whole, 0.0, 0.4 * np.sqrt(np.maximum(1 - k / union, 0.05) / k))


def _groups(batches: Iterator[pa.RecordBatch], key: str = "g") -> Iterator[pa.RecordBatch]:
    """Whole groups from rows sorted by key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)])).tolist()
        if held and held[-1].column(b.schema.get_field_index(key))[-1].as_py() != k[0]:
            yield _whole(held)
            held = []
        for lo, hi in zip(cut[:-1], cut[1:]):
            held.append(b.slice(lo, hi - lo))
            if hi < len(k):
                yield _whole(held)
                held = []
    if held:
        yield _whole(held)


def _whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _meet(share: int, joining: bool = True):
    """(a, b, sure): pairs of a group's members, of different components, whose sketches
    agree. side 0 meets all; sides 1 and 2 meet each other and side 0. With ``joining``
    a sure pair counts as linked for the pairs after it."""
    least = share / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _groups(batches):
            ids, comp, n, side = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("rep", "comp", "n", "side"))
            if len(ids) < 2 or (comp == comp[0]).all():
                continue
            m = _matrix(b.column(b.schema.get_field_index("kept")).to_pylist())
            sig, row = bins(m), Row(m, n)
            _, label = np.unique(comp, return_inverse=True)  # components as joined so far in this task
            a_out, b_out, is_sure = [], [], []

            def emit(i, j, sure):
                a_out.append(np.minimum(ids[i], ids[j]))
                b_out.append(np.maximum(ids[i], ids[j]))
                is_sure.append(np.full(len(j), sure))

            for i in range(len(ids) - 1):
                j = np.arange(i + 1, len(ids))
                lo, hi = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                j = j[(label[j] != label[i]) & (100 * lo >= share * hi) & ((side[j] != side[i]) | (side[i] == 0))]
                if len(j):
                    j = j[(sig[j] == sig[i]).sum(axis=1) >= BINS * 19 // 32]
                if not len(j):
                    continue
                s, dev = row.estimate(i, j)
                sure = (s >= least + SIGMAS * dev - 1e-9) & joining
                if sure.any():
                    joined, first = np.unique(label[j[sure]], return_index=True)
                    emit(i, j[sure][first], True)
                    label[np.isin(label, joined)] = label[i]
                may = ~sure & (s >= least - SIGMAS * dev - 1e-9) & (label[j] != label[i])
                if may.any():
                    emit(i, j[may], False)
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a_out, b_out, is_sure)], ["a", "b", "sure"])

    return run


def _tuples(r: int, b: int, level: int):
    """New list keys from tuples of retained values."""
    rng = np.random.default_rng(level)
    chosen = np.stack([rng.permutation(BINS)[:r] for _ in range(b)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 1000):
                x = big.slice(lo, 1000)
                v = bins(_matrix(x.column(2).to_pylist())).astype(G.U)
                keys = np.zeros((len(v), b), G.U)
                for j, c in enumerate(G.constants(r)):
                    keys += v[:, chosen[:, j]] * c
                keys = G.mix(keys + np.arange(b, dtype=G.U) * G.U(0x9E3779B97F4A7C15))
                some = (v[:, chosen] != _PAD).any(axis=2).ravel()
                at = np.repeat(np.arange(len(v)), b)[some]
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([x.column(0).take(at), x.column(1).take(at), x.column(3).take(at), pa.array(keys.ravel()[some].view(np.int64))], ["rep", "n", "comp", "key"])

    return run


def _estimated(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 1000):
                x = big.slice(lo, 1000)
                s, dev = estimate(_matrix(x.column(2).to_pylist()), _matrix(x.column(3).to_pylist()))
                ok = pa.array(s >= share / 100 - SIGMAS * dev - 1e-9)
                yield pa.RecordBatch.from_arrays([x.column(i).filter(ok) for i in (0, 1)], ["a", "b"])

    return run


def verify(scratch: Scratch, pairs: DataFrame, docs: DataFrame, sizes: DataFrame, width: int, share: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets reach the share.

    Pairs of one a go together, so that a's text travels once per chunk; a chunk
    holds partners of some CHUNK shingles, however many partners a has."""
    spark = scratch.spark
    sized = pairs.join(sizes.select(F.col("rep").alias("b"), "n"), "b")
    parts = sized.groupBy("a").agg(F.ceil(F.sum("n") / CHUNK).alias("parts"))
    dealt = scratch.save(sized.join(parts, "a").select(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts"))).alias("g"), "a", "b"), "dealt")
    needs = dealt.select("g", F.col("a").alias("doc_id"), F.lit(0).alias("role"), F.lit(None).cast("long").alias("of")).distinct().union(dealt.select("g", "b", F.lit(1), "a"))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    found = needs.select(slot.alias("s")).groupBy(F.shiftright("s", 5).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(F.lit(31)).cast("int"))).alias("m")).toPandas()
    bits = np.zeros(SLOTS // 32, np.int64)
    bits[found["w"].to_numpy(np.int64)] = found["m"].to_numpy(np.int64)
    sent = spark.sparkContext.broadcast(bits)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for b in batches:
            s = b.column(2).to_numpy()
            ok = pa.array((table[s >> 5] >> (s & 31)) & 1 == 1)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["doc_id", "text"])

    texts = docs.select("doc_id", "text", slot.alias("s")).where("doc_id IS NOT NULL").mapInArrow(needed, "doc_id long, text string")
    rows = needs.join(texts, "doc_id").select("g", "role", "of", "doc_id", "text")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hubs: dict[int, np.ndarray] = {}
        last = None
        for b in slices(batches, "text"):
            found = sets(*utf8(b.column(4)), width)
            out = []
            for g, role, of, doc, x in zip(*(b.column(i).to_pylist() for i in range(4)), found):
                if g != last:
                    hubs, last = {}, g
                if role == 0:
                    hubs[doc] = x
                elif (y := hubs.get(of)) is not None and len(x) and len(y):
                    small, large = (x, y) if len(x) < len(y) else (y, x)
                    if 100 * len(small) < share * len(large):
                        continue
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int(np.count_nonzero(large[at] == small))
                    if 100 * both >= share * (len(x) + len(y) - both):
                        out.append((of, doc))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], ["a", "b"])

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    links = rows.repartition(n, "g").sortWithinPartitions("g", "role").mapInArrow(exact, "a long, b long")
    links = scratch.save(links.distinct(), "links")
    scratch.drop(dealt)
    return links


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, comp) of all edges (u, v) of one task: each root hangs on the smallest it meets."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    u, v = (np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in (0, 1))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, label = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while (label[u] != label[v]).any():
        np.minimum.at(label, np.maximum(label[u], label[v]), np.minimum(label[u], label[v]))
        while (label != label[label]).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["rep", "comp"])


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(rep, comp) for every end of a link; comp is the smallest reachable end."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    if links.count() <= EDGES:
        return edges.coalesce(1).mapInArrow(_joined, "rep long, comp long")
    edges = scratch.save(edges.distinct(), "edges")
    state = lambda e: e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    before = state(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).where("u <> v").distinct()
        small = scratch.save(small, "small")
        scratch.drop(edges)
        edges, now = small, state(small)
        if now == before:
            break
        before = now
    found = edges.select(F.col("u").alias("rep"), F.col("v").alias("comp"))
    return found.union(edges.select(F.col("v").alias("rep"), F.col("v").alias("comp")).distinct())


def _labelled(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return rows.withColumn("comp", F.col("rep"))
    return rows.join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def _stats(lists: DataFrame) -> DataFrame:
    """Lists with more than one component: pairs between components, largest component."""
    each = lists.groupBy("key", "comp").agg(F.count("*").alias("c"))
    stats = each.groupBy("key").agg(F.sum("c").alias("size"), F.sum(F.col("c") * F.col("c")).alias("sq"), F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("nc"))
    return stats.where("nc > 1").select("key", "size", (F.col("size") * F.col("size") - F.col("sq")).alias("cross"), F.col("top.c").alias("top_n"), F.col("top.comp").alias("top"))


def _dealt_near(lists: DataFrame) -> DataFrame:
    """Members outside the largest component go to each of its blocks."""
    parts = F.ceil(F.col("top_n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), parts).cast("int")
    part = F.when(F.col("comp") == F.col("top"), F.array(own)).otherwise(F.sequence(F.lit(0), parts - 1))
    rows = lists.select("key", "rep", "n", "comp", F.explode(part).alias("i"))
    return rows.select(F.xxhash64("key", "i").alias("g"), "rep", "n", "comp", F.lit(0).alias("side"))


def _dealt_far(lists: DataFrame) -> DataFrame:
    """Each block of members meets each other block."""
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), parts).cast("int")
    pair = F.transform(F.sequence(F.lit(0), parts - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j"), F.when(x == own, 0).when(x > own, 1).otherwise(2).alias("side")))
    rows = lists.select("key", "rep", "n", "comp", F.explode(pair).alias("p"))
    return rows.select(F.xxhash64("key", "p.i", "p.j").alias("g"), "rep", "n", "comp", "p.side")


def link(scratch: Scratch, docs: DataFrame, reps: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame | None:
    """(rep, comp) of all linked class representatives ``reps`` (rep, n, kept, rest)."""
    sizes, kept = reps.select("rep", "n"), reps.select("rep", "kept")
    alike = lambda x, y: (F.least(x, y) * 100 >= F.greatest(x, y) * share)
    n_tasks = max(1, int(scratch.spark.conf.get("spark.sql.shuffle.partitions")))
    links, comp = None, None

    def met(dealt: DataFrame, joining: bool = True) -> DataFrame:
        rows = dealt.join(kept, "rep").select("g", "rep", "n", "comp", "side", "kept")
        return rows.repartition(n_tasks, "g").sortWithinPartitions("g").mapInArrow(_meet(share, joining), "a long, b long, sure boolean")

    def confirm(pairs: DataFrame) -> DataFrame:
        nonlocal links, comp
        found = verify(scratch, pairs.select("a", "b"), docs, sizes, width, share)
        links = found if links is None else links.union(found)
        comp = scratch.save(components(scratch, links), "components")
        links = comp.select(F.col("rep").alias("a"), F.col("comp").alias("b")).where("a <> b")
        return found

    def add(dealt: list[DataFrame], star: DataFrame | None = None):
        pairs = [met(d) for d in dealt] + ([star.select("a", "b", F.lit(False).alias("sure"))] if star is not None else [])
        pairs = scratch.save(reduce(DataFrame.union, pairs).groupBy("a", "b").agg(F.max("sure").alias("sure")), "pairs")
        if pairs.isEmpty():
            return
        found = confirm(pairs)
        failed = pairs.where("sure").join(found, ["a", "b"], "left_anti").select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        if not failed.isEmpty():  # what was left out behind them is looked at again
            failed = scratch.save(failed, "failed")
            every = reduce(DataFrame.union, dealt)
            again = every.join(every.join(failed, "rep").select("g").distinct(), "g")
            scratch.drop(pairs)
            pairs = scratch.save(met(_labelled(again.drop("comp"), comp).select(*every.columns), False).select("a", "b").distinct(), "pairs")
            if not pairs.isEmpty():
                confirm(pairs)
        scratch.drop(pairs)

    members = listed(scratch, reps)
    done = [members]
    members = members.withColumn("comp", F.col("rep"))
    carried, used = None, []
    for level in range(len(LEVELS) + 1):
        counts = members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
        kind = [] if level else ["kind"]
        lists = scratch.save(members.join(counts, "key").select("key", "rep", "n", "comp", "m", *kind), "every")
        scratch.drop(*done)
        if level == 0:
            # Who met no hot value and shares one listed value only with anybody has no partner: a linked
            # pair shares less than two of ten with probability 4e-6. Tuples are too few for this.
            every, shared = lists, lists.groupBy("rep").agg(F.count("*").alias("k"), F.max("kind").alias("kind")).where("k > 1 OR kind > 0").select("rep")
            lists = scratch.save(every.join(shared, "rep").select("key", "rep", "n", "comp", "m"), "lists")
            scratch.drop(every)
        short, long = lists.where(F.col("m") <= LONG), lists.where(F.col("m") > LONG)
        if comp is not None:
            short = short.join(_stats(short).select("key"), "key")
        dealt = [short.select(F.xxhash64("key").alias("g"), "rep", "n", "comp", F.lit(0).alias("side"))]
        if carried is not None:
            dealt.append(carried)
        star = None
        some_long = not long.isEmpty()
        if some_long:
            score = long.groupBy("rep").agg(F.sum("m").alias("score"))
            scored = long.join(score, "rep")
            hubs = scored.groupBy("key").agg(F.max(F.struct("score", "rep", "n", "comp")).alias("hub"))
            star = scored.join(hubs, "key").where((F.col("hub.comp") != F.col("comp")) & alike(F.col("hub.n"), F.col("n")))
            star = star.select(F.least("hub.rep", "rep").alias("a"), F.greatest("hub.rep", "rep").alias("b")).distinct()
            star = star.join(kept.select(F.col("rep").alias("a"), F.col("kept").alias("ka")), "a").join(kept.select(F.col("rep").alias("b"), F.col("kept").alias("kb")), "b")
            star = star.select("a", "b", "ka", "kb").mapInArrow(_estimated(share), "a long, b long")
        add(dealt, star)
        scratch.drop(*used)
        carried, done, used = None, [], []
        if not some_long:
            break
        long = _labelled(long.select("key", "rep", "n"), comp)
        open_lists = scratch.save(long.join(_stats(long), "key"), "open")
        scratch.drop(lists)
        used = [open_lists]
        few = (F.col("size") - F.col("top_n") <= LONG) & (F.col("cross") <= F.col("size") * CROSS)
        near, rest = open_lists.where(few), open_lists.where(~few)
        some = F.col("cross") <= F.col("size") * CROSS
        far = rest.where(~some)
        carried = _dealt_near(near).union(_dealt_far(rest.where(some)))
        if level == len(LEVELS):
            add([carried, _dealt_far(far)])
            break
        dense = scratch.save(far.select("rep", "comp").distinct().join(reps, "rep").select("rep", "n", "kept", "comp"), "dense")
        if dense.isEmpty():
            add([carried])
            break
        done = [dense]
        members = dense.mapInArrow(_tuples(*LEVELS[level], level), "rep long, n long, comp long, key long").distinct()
    return comp


def near_duplicates(docs: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    return _judged(docs, width, share).drop("fp")


def _judged(docs: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """near_duplicates with the identity of each row's set, fp."""
    docs = docs.select("doc_id", "text")
    scratch = Scratch(docs.sparkSession, "near-dedup")
    found = scratch.save(sketch(docs, width), "sketches")
    classes = scratch.save(found.where("n > 0 AND doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    # where rows of one doc_id stand for several sets, one of the sets stands for them
    one = classes.groupBy("rep").agg(F.min("fp").alias("of"))
    reps = found.join(one, found["doc_id"] == one["rep"]).where(found["fp"] == one["of"]).dropDuplicates(["rep"])
    reps = scratch.save(reps.select("rep", "n", "kept", "rest"), "representatives")
    light = scratch.save(found.select("doc_id", "n", "fp"), "sets")
    scratch.drop(found)
    found, comp = light, link(scratch, docs, reps, width, share)
    out = found.select("doc_id", "n", "fp").join(classes, "fp", "left")
    out = _labelled(out.withColumn("rep", F.when(F.col("n") > 0, F.col("rep"))), comp)
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id"))
    scratch.drop(reps)
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"), "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that nearly repeat another document; of rows
    with one doc_id and one shingle set the one with the least text stays, rows with
    null doc_id all stay; other columns come through, whatever their names."""
    docs, named = sheltered(docs, ("__gone", "__set", "__again", "__fp", "__rn"))
    return named(_kept(docs, _judged(docs)))


def _kept(docs: DataFrame, found: DataFrame) -> DataFrame:
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("__gone"), F.col("fp").alias("__set")).distinct()
    is_gone = F.col("doc_id") == F.col("__gone")
    repeated = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again"))
    if repeated.limit(1).count() == 0:
        return docs.join(gone, is_gone, "left_anti")
    again = F.col("doc_id") == F.col("__again")
    once = docs.join(repeated, again, "left_anti").join(gone, is_gone, "left_anti")
    # of one doc_id one row may repeat another document and the next one not
    more = _one_each(docs.join(repeated, again, "left_semi")).join(gone, is_gone & (F.col("__fp") == F.col("__set")), "left_anti")
    return once.unionByName(more.drop("__fp"))


def _one_each(docs: DataFrame) -> DataFrame:
    """One row of each (doc_id, shingle set), with the set's identity __fp: the least text, then the least other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = docs_columns.index("text")
        for b in slices(batches, "text"):
            fp = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets(*utf8(b.column(at)), WIDTH)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp, pa.binary())], [*docs_columns, "__fp"])

    docs_columns = docs.columns
    marked = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__fp", BinaryType())]))
    order = [F.col(f"`{c}`") for c in ("text", *(c for c in docs_columns if c not in ("doc_id", "text")))]
    first = F.row_number().over(Window.partitionBy("doc_id", "__fp").orderBy(*order))
    return marked.withColumn("__rn", first).where("__rn = 1").drop("__rn")
