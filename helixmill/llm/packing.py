"""Harmonic packing of tokenised documents into sequences of at most ``SIZE`` tokens.

A document is cut into full sequences, then powers of two from SIZE / 2 down to
``LEAST``, then a tail shorter than LEAST. A piece of length l belongs to class
k = SIZE div l, and a bin of class k takes exactly k pieces. So a bin of a power
of two is full, and a bin of tails wastes less than one tail, 1 / 33 at most.

Workers fill bins on their own, one partition at a time; the fewer than k pieces
per class that a worker has left go on to the next round, in which ``FAN`` workers'
rests are packed together, until one group is left. Its rest, fewer than k pieces
in each class whatever the input, is packed by first fit, longest first.

Pieces are written to the shared folder before the second round, so that texts
are tokenised once and a lost executor repeats only its own partitions.

Token ids are those that the tokenizers library gives for the byte-level BPE file at
the path: text of an added token is that token. They are computed by tiktoken on the
very ranks in that file; ``same_ids`` compares them with the library.

Cases: null or empty text is the end token alone; repeated rows are packed each
time; null ids are handed on; no rows give no rows; extra columns are not read.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.llm.common import Scratch, slices

SIZE, END, LEAST, FAN = 2048, 1, 64, 64
#: Bytes of text given to the tokenizer's regular expression at once.
PARTS = 1 << 16

PIECE = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the others
    as the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a byte-level BPE file whose ids are in merge order."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        _encoders[path] = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def token_ids(enc, text: str) -> np.ndarray:
    """Ids of a text: added tokens split it first, of several at one place the longest."""
    if not any(t in text for t in enc.special_tokens_set):
        return plain_ids(enc, text)
    added = "|".join(re.escape(t) for t in sorted(enc.special_tokens_set, key=len, reverse=True))
    parts = re.split(f"({added})", text)  # every second part is an added token
    return np.concatenate([np.array([enc.encode_single_token(x)], np.uint32) if i % 2 else plain_ids(enc, x) for i, x in enumerate(parts)])


def plain_ids(enc, text: str) -> np.ndarray:
    """Ids of a text without added tokens. Long texts are encoded part by part, cut where
    a blank stands between two letters or digits, at which the pattern always splits."""
    if len(text) <= PARTS:
        return np.array(enc.encode_ordinary(text), np.uint32)
    out, at = [], 0
    while at < len(text):
        cut = at + PARTS
        while cut < len(text) - 1 and not (text[cut] == " " and text[cut - 1].isalnum() and text[cut + 1].isalnum()):
            cut += 1
        cut = cut if cut < len(text) - 1 else len(text)
        out.append(np.array(enc.encode_ordinary(text[at:cut]), np.uint32))
        at = cut
    return np.concatenate(out)


def same_ids(texts: list[str], path: str) -> bool:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    enc = encoder(path)
    return all(e.ids == token_ids(enc, x).tolist() for e, x in zip(t.encode_batch(texts, add_special_tokens=False), texts))


def cuts(n: int, size: int = SIZE, least: int = LEAST) -> list[int]:
    """Lengths of a document's pieces."""
    out, rest, step = [size] * (n // size), n % size, size // 2
    while step >= least:
        if rest >= step:
            out.append(step)
            rest -= step
        step //= 2
    return out + [rest] * (rest > 0)


class Bins:
    """Bins of each class; a worker's sequences are numbered from ``first``."""

    def __init__(self, size: int, first: int):
        self.size, self.next = size, first
        self.open: dict[int, list[list]] = defaultdict(list)

    def add(self, piece: list) -> list[list]:
        """The pieces of a bin that is now full, placed."""
        k = self.size // piece[2]
        held = self.open[k]
        held.append(piece)
        if len(held) < k:
            return []
        del self.open[k]
        return self.place(held)

    def place(self, pieces: list[list]) -> list[list]:
        at = 0
        for p in pieces:
            p[5], p[6] = self.next, at
            at += p[2]
        self.next += 1
        return pieces

    def rest(self) -> list[list]:
        return [p for held in self.open.values() for p in held]

    def first_fit(self) -> list[list]:
        """The rest by first fit, longest first: the tightest bin by a heap of free room."""
        bins: list[list] = []
        free: list[tuple[int, int]] = []
        for p in sorted(self.rest(), key=lambda p: (-p[2], p[0] is None, p[0] or 0, p[1])):
            if free and -free[0][0] >= p[2]:
                room, i = heapq.heappop(free)
            else:
                room, i = -self.size, len(bins)
                bins.append([])
            bins[i].append(p)
            heapq.heappush(free, (room + p[2], i))
        return [p for b in bins for p in self.place(b)]


def _batch(rows: list[list], extra: list[int] | None = None) -> pa.RecordBatch:
    cols = [pa.array(list(c), pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 7
    names = PIECE.names
    if extra is not None:
        cols, names = [*cols, pa.array(extra, pa.int64())], [*names, "worker"]
    return pa.RecordBatch.from_arrays(cols, names)


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, least: int = LEAST, fan: int = FAN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    path = path or vocabulary_path()
    scratch = Scratch(spark, "packing")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, worker = encoder(path), TaskContext.get().partitionId()
        bins = Bins(size, worker << 32)
        for b in slices(batches, "text"):
            out: list[list] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(token_ids(enc, text or ""), np.uint32(END)).astype("<u4")
                at = 0
                for n in cuts(len(ids), size, least):
                    out += bins.add([doc, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids), None, None])
                    at += n
            yield _batch(out, [worker] * len(out))
        rest = bins.rest()
        yield _batch(rest, [worker] * len(rest))

    def again(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bins, worker = None, None
            for b in batches:
                out: list[list] = []
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    if bins is None or row[7] != worker:
                        if bins is not None:
                            end = bins.first_fit() if last else bins.rest()
                            yield _batch(end, [worker] * len(end))
                        worker = row[7]
                        bins = Bins(size, level << 56 | worker << 32)
                    out += bins.add([*row[:7]])
                yield _batch(out, [worker] * len(out))
            if bins is not None:
                end = bins.first_fit() if last else bins.rest()
                yield _batch(end, [worker] * len(end))

        return run

    schema = T.StructType([*PIECE.fields, T.StructField("worker", T.LongType())])
    pieces = scratch.save(docs.select("doc_id", "text").mapInArrow(first, schema), "pieces")
    done = pieces.where("sequence_id IS NOT NULL").drop("worker")
    workers = (pieces.agg(F.max("worker")).first()[0] or 0) + 1
    level = 1
    while True:
        workers = -(-workers // fan)
        rest = pieces.where("sequence_id IS NULL").withColumn("worker", F.floor(F.col("worker") / fan))
        rest = rest.repartition(workers, "worker").sortWithinPartitions("worker", "length", "doc_id", "start", "ids_crc32")
        pieces = scratch.save(rest.mapInArrow(again(level, workers == 1), schema), f"round{level}")
        done = done.union(pieces.where("sequence_id IS NOT NULL").drop("worker"))
        if workers == 1:
            return done
        level += 1
