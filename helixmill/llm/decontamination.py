"""Benchmark decontamination by winnowing.

Of every window of W consecutive k-gram hashes the smallest is kept as a
fingerprint, in the items and in the documents, so that any shared span of
k + W - 1 words holds a fingerprint at the same place on both sides. Documents
look their fingerprints up in the items' fingerprints and each meeting is
extended along its diagonal to the full run of equal words.

The items are a stated query set. They go to the executors in blocks of at most
``BLOCK_BYTES`` of text, whatever the number of items, so documents are neither
shuffled nor collected and a key that many documents share stays local to them.

Cases: a null text has no words; an item without words never occurs; items or
documents that repeat count each time; an item of fewer than ``SPAN`` words
occurs where all its words do; ids are handed on as they are, null included;
only the named columns are read, extra columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.llm import grams as G
from helixmill.llm.common import Scratch, bounded_batches, sheltered, slices, utf8

SPAN = 10  # words of a window
K = 5  # words of a fingerprint's gram
BLOCK_BYTES = 16 << 20

#: Hidden columns that are added to the rows of documents.
HIT, ITEMS, WORDS = "__hit", "__items", "__words"


def _winnow(h: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram hashes, offset of the right-most smallest gram of each window)."""
    g = G.grams(h, k)
    n = len(g) - (span - k)
    if n <= 0:
        return g, np.zeros(0, np.int64)
    best, where = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, span - k + 1):
        less = g[j : j + n] <= best
        best[less] = g[j : j + n][less]
        where[less] = j
    return g, where + np.arange(n)


class Fingerprints:
    """Fingerprints of one block of items, by length of the shortest span."""

    def __init__(self, items: list[tuple[str, str]], span: int = SPAN, k: int = K):
        self.ids = [i for i, _ in items]
        raw, at = utf8(pa.array([t for _, t in items], pa.large_string()))
        w = G.words(raw, at, G.ALNUM)
        self.words, self.first = w.hashes, w.first
        self.span, self.k = span, min(k, span)
        kinds: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for i in range(len(items)):
            h = w.hashes[w.first[i] : w.first[i + 1]]
            if not len(h):
                continue
            s = min(span, len(h))
            g, at_ = _winnow(h, self.k if s == span else s, s)
            at_ = np.unique(at_)
            kinds.setdefault(s, []).append((g[at_], np.full(len(at_), i), at_))
        self.kinds = {s: (G.Index(np.concatenate([x[0] for x in v])), np.concatenate([x[1] for x in v]), np.concatenate([x[2] for x in v])) for s, v in kinds.items()}

    def runs(self, w: G.Words) -> list[tuple[int, int, int, int]]:
        """(document, item, start, end) of each run of words that an item shares."""
        found = []
        doc, room = G.doc_of(w.first), G.room(w.first)
        for s, (index, item_of, offset_of) in self.kinds.items():
            if s == self.span:
                g, at = _winnow(w.hashes, self.k, s)
                at = np.unique(at[room[: len(at)] >= s])
            else:
                g = G.grams(w.hashes, s)
                at = np.flatnonzero(room[: len(g)] >= s)
            hit, row = index.find(g[at])
            if not len(hit):
                continue
            p, item, q = at[hit], item_of[row], offset_of[row]
            for d, i, shift in np.unique(np.stack([doc[p], item, p - q]), axis=1).T.tolist():
                length = int(self.first[i + 1] - self.first[i])
                lo, hi = max(shift, int(w.first[d])), min(shift + length, int(w.first[d + 1]))
                same = w.hashes[lo:hi] == self.words[self.first[i] + lo - shift : self.first[i] + hi - shift]
                edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False]))))
                found += [(d, i, lo + a, lo + b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= s]
        return found


def _add(schema: pa.Schema, spec, text: str, earlier: bool):
    """Batches with the hits of one block of items added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints: Fingerprints = spec.value
        for b in slices(batches, text):
            w = G.words(*utf8(b.column(b.schema.get_field_index(text))), G.ALNUM)
            n = b.num_rows
            spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
            items: list[set] = [set() for _ in range(n)]
            if earlier:
                for d, (x, y) in enumerate(zip(b.column(HIT).to_pylist(), b.column(ITEMS).to_pylist())):
                    spans[d] += [(s["start"], s["end"]) for s in x]
                    items[d] |= {(i["row"], i["id"]) for i in y}
            for d, i, lo, hi in prints.runs(w):
                spans[d].append((lo - int(w.first[d]), hi - int(w.first[d])))
                items[d].add(prints.ids[i])
            merged = []
            for x in spans:
                out: list[dict] = []
                for lo, hi in sorted(x):
                    if out and lo <= out[-1]["end"]:
                        out[-1]["end"] = max(out[-1]["end"], hi)
                    else:
                        out.append({"start": lo, "end": hi})
                merged.append(out)
            given = [c for i, c in enumerate(b.columns) if b.schema.names[i] not in (HIT, ITEMS, WORDS)]
            yield pa.RecordBatch.from_arrays([*given, pa.array(np.diff(w.first), pa.int64()), pa.array(merged, schema.field(HIT).type), pa.array([[{"row": r, "id": i} for r, i in sorted(x, key=lambda t: t[0])] for x in items], schema.field(ITEMS).type)], schema=schema)

    return run


def find_benchmark_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", span: int = SPAN, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` with three columns more: ``__words`` (number of words),
    ``__hit`` (merged word ranges within occurrences of a window) and ``__items``
    (the items that occur, by row and id); given columns of these names are left out."""
    docs = docs.drop(WORDS, HIT, ITEMS)
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    add = T.StructType([
        T.StructField(WORDS, T.LongType()),
        T.StructField(HIT, T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField(ITEMS, T.ArrayType(T.StructType([T.StructField("row", T.LongType()), T.StructField("id", T.StringType())]))),
    ])
    schema = T.StructType([*docs.schema.fields, *add.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, scratch = to_arrow_schema(schema), None

    def blocks() -> Iterator[list]:
        block, size = [], 0
        for row, r in enumerate(benchmark.select(F.col("item_id").cast("string"), F.col("text")).toLocalIterator()):
            block.append(((row, r[0]), r[1]))
            size += len(r[1] or "") * 2 + 64
            if size >= block_bytes:
                yield block
                block, size = [], 0
        yield block

    out, done, before = docs, 0, None
    for block in blocks():
        if done and not block:
            break
        if done:
            scratch = scratch or Scratch(spark, "decontamination")
            out = scratch.save(out, "spans")
            if before is not None:
                scratch.drop(before)
            before = out
        out = out.mapInArrow(_add(arrow, spark.sparkContext.broadcast(Fingerprints(block, span, k)), text, done > 0), schema)
        done += 1
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    digest = _items_digest
    out = find_benchmark_spans(docs.select("doc_id", "text"), benchmark, **options).select(
        "doc_id",
        F.col(WORDS).alias("n_words"),
        F.aggregate(HIT, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_hit"),
        F.size(ITEMS).cast("long").alias("n_items"),
        digest(F.col(ITEMS)).alias("items_sha256"),
        (F.size(HIT) > 0).alias("contaminated"),
    )
    return out


def _items_digest(items):
    """SHA-256 of the item ids, sorted as strings and comma-joined; null ids are left out."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: x["id"])), ","), 256)


def digest_of(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with all their columns."""
    docs, named = sheltered(docs, (WORDS, HIT, ITEMS))
    return named(find_benchmark_spans(docs, benchmark).where(F.size(HIT) == 0).drop(WORDS, HIT, ITEMS))
