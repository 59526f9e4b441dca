"""Perplexity scores from a Brown class-based bigram model.

P(w | previous) = P(class(w) | class(previous)) * P(w | class(w)).

Tokens are runs of non-space characters, A-Z lower-cased, and one end token per
document; a token is known by a 64-bit hash. All counts cover all training rows.

1. Anchors. Words are counted over all training rows. The bigram matrix of the
   ``ANCHORS`` most frequent ones (and the end) is summed in the cluster, and exchange
   clustering on the driver, on a matrix of that fixed size, moves each anchor to the
   class that raises the mutual information of adjacent classes most, until nothing moves.
2. Exchange for all other words. Each word's counts of left and right neighbouring
   anchor classes are summed over the corpus, by word, and the word goes to the
   class under which these neighbours are likeliest; words that never stand next
   to an anchor share one class of their own.
3. Scoring. Documents meet the counts and classes of their own words, chunk by
   chunk: a chunk is a split of the input, and what travels is one row for each
   distinct word of a chunk, not each token. Class transitions are summed from the
   scored training rows, then applied.

Unknown words form one more type, as in the base score: its probability after a
class is that of a word seen once in training (the leave-one-out estimate), so all
types' probabilities sum to 1.

Cases: null text is empty and still ends; without training rows every token is
unknown; ids that are null hash as the empty text and are handed on; repeated
rows count each time; extra columns are not read; a very long text is one slice of its
own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm import grams as G
from helixmill.llm.common import Scratch, slices, utf8
from helixmill.llm.near_dedup import _whole

ANCHORS, CLASSES = 512, 32
#: Class 0 holds the end token, the last class words without anchors around them.
REST, UNKNOWN = CLASSES - 1, CLASSES
STATES = CLASSES + 1
PRIOR = 10.0  # weight of class frequencies in a transition row
FLUSH = 4_000_000  # tokens that a task gathers before it sums them up
CHUNK_BYTES = 16 << 20
END = np.uint64(1)


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes with an end token after each document, first token of each document)."""
    w = G.words(*utf8(text), G.NOT_SPACE)
    return np.insert(w.hashes, w.first[1:], END), w.first + np.arange(len(w.first))


def held_out(mod: int = 7) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(mod)) == 2




def find_anchors(train: DataFrame, k: int = ANCHORS) -> np.ndarray:
    """The k most frequent words, by counts of all tokens, and the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def summed() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

        for b in slices(batches, "text"):
            held.append(tokens(b.column(0))[0])
            if sum(map(len, held)) >= FLUSH:
                yield summed()
        if held:
            yield summed()

    top = train.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(k)
    found = top.toPandas()["h"].to_numpy(np.int64).view(G.U)
    return np.unique(np.append(found, END))


def _at(sorted_keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Row of each hash in sorted keys, -1 if absent."""
    i = np.minimum(np.searchsorted(sorted_keys, h), len(sorted_keys) - 1)
    return np.where(sorted_keys[i] == h, i, -1)


def anchor_bigrams(train: DataFrame, anchors: np.ndarray) -> np.ndarray:
    k = len(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for b in slices(batches, "text"):
            h, first = tokens(b.column(0))
            a = _at(anchors, h)
            before = np.roll(a, 1)
            before[first[:-1]] = _at(anchors, np.array([END]))[0]
            ok = (a >= 0) & (before >= 0)
            total += np.bincount(before[ok] * k + a[ok], minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["at", "n"])

    rows = train.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(k * k, np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out.reshape(k, k)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, end: int, classes: int = CLASSES, sweeps: int = 20) -> np.ndarray:
    """Class of each anchor: 0 for the end, 1 to classes - 2 for the others."""
    k = len(bigrams)
    order = np.argsort(-bigrams.sum(axis=1), kind="stable")
    of = np.zeros(k, int)
    rank = [i for i in order.tolist() if i != end]
    for r, i in enumerate(rank):
        of[i] = 1 + r % (classes - 2)
    one = np.zeros((k, classes))
    one[np.arange(k), of] = 1
    b = one.T @ bigrams @ one
    for _ in range(sweeps):
        moved = 0
        for w in rank:
            right, left = np.bincount(of, bigrams[w], classes), np.bincount(of, bigrams[:, w], classes)
            own, c = bigrams[w, w], of[w]
            right[c] -= own
            left[c] -= own
            b[c] -= right
            b[:, c] -= left
            b[c, c] -= own
            rows, cols = b.sum(axis=1), b.sum(axis=0)
            gain = (_xlogx(b + right) - _xlogx(b)).sum(axis=1) + (_xlogx(b + left[:, None]) - _xlogx(b)).sum(axis=0)
            d = np.diag(b)
            gain += _xlogx(d + right + left + own) - _xlogx(d + right) - _xlogx(d + left) + _xlogx(d)
            gain -= _xlogx(rows + right.sum() + own) - _xlogx(rows) + _xlogx(cols + left.sum() + own) - _xlogx(cols)
            gain[[0, classes - 1]] = -np.inf
            new = int(gain.argmax())
            new = c if gain[c] >= gain[new] - 1e-9 else new
            moved += new != c
            of[w] = new
            b[new] += right
            b[:, new] += left
            b[new, new] += own
        if not moved:
            break
    return of


def chunked(docs: DataFrame) -> DataFrame:
    """doc_id, text, train, and the chunk: the input split, or the partition of a table that does
    not come from files, dealt further by id and text if splits are large."""
    split = docs.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    parts = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, int(split) // CHUNK_BYTES)))
    source = F.when(F.input_file_name() == "", F.spark_partition_id()).otherwise(-1)
    return docs.select("doc_id", "text", (~held_out()).alias("train"), F.xxhash64(F.input_file_name(), F.input_file_block_start(), source, parts).alias("chunk"))


def word_rows(docs: DataFrame, anchors: np.ndarray, of: np.ndarray) -> DataFrame:
    """(h, chunk, c, around): training count and neighbouring anchor classes of each word of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            h, chunk, n, left, right = (np.concatenate(x) for x in zip(*held))
            held.clear()
            size = 0
            order = np.lexsort((h, chunk)) if (chunk != chunk[0]).any() else np.argsort(h, kind="stable")
            h, chunk = h[order], chunk[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (chunk[1:] != chunk[:-1])))
            at, word = np.flatnonzero(new), np.cumsum(new) - 1
            left, right = left[order], right[order]
            code = np.concatenate([(word * (2 * CLASSES) + left)[left >= 0], (word * (2 * CLASSES) + CLASSES + right)[right >= 0]])
            code, times = np.unique(code, return_counts=True)
            of_word = code // (2 * CLASSES)
            packed = ((code % (2 * CLASSES)).astype(np.uint32) << np.uint32(24)) | np.minimum(times, (1 << 24) - 1).astype(np.uint32)
            ends = np.searchsorted(of_word, np.arange(len(at) + 1)).astype(np.int32) * 4
            around = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
            return pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(chunk[at]), pa.array(np.add.reduceat(n[order], at).astype(np.int64)), around], ["h", "chunk", "c", "around"])

        for b in slices(batches, "text"):
            h, first = tokens(b.column(0))
            train = np.repeat(b.column(1).to_numpy(zero_copy_only=False), np.diff(first))
            chunk = np.repeat(b.column(2).to_numpy(), np.diff(first))
            a = _at(anchors, h)
            cls = np.where(a >= 0, of[a], -1)
            left, right = np.roll(cls, 1), np.roll(cls, -1)
            left[first[:-1]] = 0
            right[first[1:] - 1] = -1
            skip = (a >= 0) | ~train
            left[skip], right[skip] = -1, -1
            held.append((h, chunk, train, left.astype(np.int8), right.astype(np.int8)))
            size += len(h)
            if size >= FLUSH:
                yield flush()
        if held:
            yield flush()

    return docs.select("text", "train", "chunk").mapInArrow(run, "h long, chunk long, c long, around binary")


def classified(rows: DataFrame, anchors: np.ndarray, of: np.ndarray, bigrams: np.ndarray) -> DataFrame:
    """(h, chunk, c, class, lead): total count and class of each word for each chunk that holds it; lead marks one row per word."""
    one = np.zeros((len(of), CLASSES))
    one[np.arange(len(of)), of] = 1
    b = one.T @ bigrams @ one + 0.5
    b = np.log(b / b.sum(axis=1, keepdims=True))
    weight = np.concatenate([b, b.T])  # left neighbours, right neighbours

    def settle(b: pa.RecordBatch) -> pa.RecordBatch:
        h = b.column(0).to_numpy().view(G.U)
        new = np.concatenate(([True], h[1:] != h[:-1]))
        at, word = np.flatnonzero(new), np.cumsum(new) - 1
        c = np.add.reduceat(b.column(2).to_numpy(), at)
        raw = b.column(3).cast(pa.large_binary())
        ends = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
        packed = np.frombuffer(raw.buffers()[2], np.uint32, int(ends[-1] - ends[0]) // 4, int(ends[0])) if ends[-1] > ends[0] else np.zeros(0, np.uint32)
        row = np.repeat(word, np.diff(ends) // 4)
        x = np.bincount(row * (2 * CLASSES) + (packed >> np.uint32(24)), packed & np.uint32(0xFFFFFF), len(at) * 2 * CLASSES).reshape(-1, 2 * CLASSES)
        score = x @ weight
        score[:, [0, REST]] = -np.inf
        cls = np.where(x.any(axis=1), score.argmax(axis=1), REST)
        a = _at(anchors, h[at])
        cls = np.where(a >= 0, of[a], cls)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(c[word]), pa.array(cls[word].astype(np.int32)), pa.array(new)], ["h", "chunk", "c", "class", "lead"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            h = b.column(0).to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last word may go on
            if cut:
                yield settle(_whole([*held, b.slice(0, cut)]))
                held = [b.slice(cut)]
            elif held and held[-1].column(0)[-1].as_py() != h[0]:
                yield settle(_whole(held))
                held = [b]
            else:
                held.append(b)
        if held:
            yield settle(_whole(held))

    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, "h").sortWithinPartitions("h").mapInArrow(run, "h long, chunk long, c long, class int, lead boolean")


def document_sums(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Per document: number of tokens and known ones, sums of log counts, class bigrams."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right.column("h").to_numpy().view(G.U)
        order = np.argsort(keys, kind="stable")
        keys, count, cls = keys[order], right.column("c").to_numpy()[order], right.column("class").to_numpy()[order]
        out = []
        for b in slices(iter(left.combine_chunks().to_batches()), "text"):
            train = b.column(2).to_numpy(zero_copy_only=False)
            h, first = tokens(b.column(1))
            at = np.searchsorted(keys, h)
            c = count[at]
            known = c > 0
            state = np.where(known, cls[at], UNKNOWN).astype(np.int64)
            prev = np.roll(state, 1)
            prev[first[:-1]] = 0
            doc = G.doc_of(first)
            cells = STATES * STATES
            code = [doc * cells + prev * STATES + state]
            single = (c == 1) & train[doc]
            code.append((doc * cells + prev * STATES + UNKNOWN)[single])
            after = np.roll(single, 1)
            after[first[:-1]] = False
            code.append((doc * cells + UNKNOWN * STATES + state)[after])
            code, times = np.unique(np.concatenate(code), return_counts=True)
            ends = np.searchsorted(code // cells, np.arange(b.num_rows + 1)).astype(np.int32)
            sums = lambda v: np.add.reduceat(v, first[:-1])
            out.append(pa.RecordBatch.from_arrays([
                b.column(0), pa.array(~train), pa.array(np.diff(first)), pa.array(sums(known.astype(np.int64))),
                pa.array(sums(np.log10(np.maximum(c, 1)))), pa.array(sums(np.log10(c + 1.0))),
                pa.ListArray.from_arrays(pa.array(ends), pa.array((code % cells).astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int32))),
            ], ["doc_id", "held_out", "n_tokens", "n_known", "log_c", "log_c1", "cells", "times"]))
        return pa.Table.from_batches(out)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, n_tokens long, n_known long, log_c double, log_c1 double, cells array<int>, times array<int>"
    return docs.groupBy("chunk").cogroup(dictionary.select("chunk", "h", "c", "class").groupBy("chunk")).applyInArrow(run, schema)


def transitions(cells: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Log10 of P(class and, within it, a count of 1 | previous class) from summed cells."""
    of = cells[:, :CLASSES]
    n = of.sum(axis=1)
    unknown = (cells[:, UNKNOWN] + 0.5) / (n + 1.0)
    share = (totals + 1e-3) / (totals + 1e-3).sum()
    t = (of + PRIOR * share) / (n[:, None] + PRIOR) * (1 - unknown[:, None])
    return np.log10(np.concatenate([t / np.maximum(totals, 1), unknown[:, None]], axis=1))


def score(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    scratch = Scratch(docs.sparkSession, "brown-lm")
    train = docs.select("doc_id", "text").where(~held_out())
    anchors = find_anchors(train)
    bigrams = anchor_bigrams(train, anchors)
    of = exchange(bigrams, int(_at(anchors, np.array([END]))[0]))
    parts = chunked(docs)
    words = scratch.save(classified(word_rows(parts, anchors, of), anchors, of, bigrams), "words")
    per = words.where("lead").groupBy("class").agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).toPandas()
    total, types = int(per["n"].sum()), int(per["v"].sum())
    totals = np.zeros(CLASSES)
    totals[per["class"].to_numpy(int)] = per["n"]
    sums = scratch.save(document_sums(parts, words), "sums")
    scratch.drop(words)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(STATES * STATES, np.int64)
        for b in batches:
            out += np.bincount(b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy(), len(out)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], ["at", "n"])

    rows = sums.where("NOT held_out").select("cells", "times").mapInArrow(added, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    cells = np.zeros(STATES * STATES)
    cells[rows["at"].to_numpy(int)] = rows["n"]
    table = transitions(cells.reshape(STATES, STATES), totals).ravel()
    extra = np.array([i // STATES == UNKNOWN or i % STATES == UNKNOWN for i in range(STATES * STATES)])
    given = f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, n_tokens long, n_known long, log_c double, log_c1 double"

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at, times = b.column(6).flatten().to_numpy(), b.column(7).flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(6)).to_numpy())
            # the cells of words seen once are estimates in training rows, events elsewhere
            use = ~extra[at] | b.column(1).to_numpy(zero_copy_only=False)[row]
            path = np.bincount(row[use], times[use] * table[at[use]], b.num_rows)
            n = b.column(2).to_numpy()
            base = b.column(5).to_numpy() - n * np.log10(total + types + 1.0)
            s = b.column(4).to_numpy() + path
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(np.full(len(n), total)), pa.array(base), pa.array(s), pa.array(10 ** (-s / n))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return sums.mapInArrow(final, given.split(", log_c")[0] + ", train_tokens long, base_score double, score double, perplexity double")
