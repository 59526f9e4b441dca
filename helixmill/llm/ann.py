"""Approximate nearest neighbours by collision counting over single projections.

Vectors are scaled to length 1, where the largest cosine is the smallest distance.
Each of ``PROJECTIONS`` random lines keeps its projections as one sorted array. A
query opens a window around its own projection on every array; a vector collides
once for each window it lies in. Virtual rehashing widens all windows by ``GROW``
round after round, counting only what the wider window adds, until enough vectors
collide in more than ``SHARE`` of the projections. Those are verified: exact cosine,
in double precision, on the original vectors.

Every vector is indexed. The vectors are dealt to blocks of about ``BLOCK`` by a
hash of their id, a block builds its arrays in one task, and the stated queries go
to all tasks in sets of at most ``QUERIES``. A block returns each query's nearest
``k``; those of all blocks meet per query. A block verifies ``VERIFY`` of its vectors
for a query, and ``AT_LEAST`` at least, which is what sets the recall; measured recall
is in the README. Equal vectors are one entry of a block's index.

Cases: vectors that are null, empty, zero, of another dimension than most, or hold a
null or non-finite component take no part; rows that repeat an id count as candidates
of their own; null ids take no part; ties go to the smaller id; fewer than k candidates
are all returned; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm.common import bounded_batches

PROJECTIONS, GROW, SHARE = 96, 1.5, 0.5
VERIFY, AT_LEAST = 0.18, 200
BLOCK, QUERIES = 8192, 4096


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that take part."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dim"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & fine)


def _vectors(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which is exact and keeps squares finite."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Block:
    """Sorted projections of one block's distinct vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, lines: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, x = ids[order], x[order]
        _, first, self.same = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
        self.members = np.argsort(self.same, kind="stable")  # rows of each distinct vector, ids ascending
        self.ends = np.concatenate(([0], np.cumsum(np.bincount(self.same, minlength=len(first)))))
        self.x = _scaled(x[first])
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        p = _unit(self.x) @ lines
        self.order = np.argsort(p, axis=0, kind="stable").T.copy()
        self.sorted = np.sort(p, axis=0).T.copy()

    def candidates(self, at: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query (a row of projections) the distinct vectors whose collisions pass the threshold."""
        m, n = self.sorted.shape
        enough = min(n, max(AT_LEAST, int(VERIFY * n)) + k)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(at)
        count = np.zeros((len(at), n), np.int64)
        width = 0.45 / np.sqrt(self.x.shape[1])
        lo = np.stack([np.searchsorted(s, a) for s, a in zip(self.sorted, at.T)])
        hi, open_ = lo.copy(), np.arange(len(at))
        while len(open_):
            now = at[open_].T
            left = np.minimum(lo[:, open_], np.stack([np.searchsorted(s, a) for s, a in zip(self.sorted, now - width)]))
            right = np.maximum(hi[:, open_], np.stack([np.searchsorted(s, a) for s, a in zip(self.sorted, now + width)]))
            left_out = []
            for j, q in enumerate(open_.tolist()):
                added = [o[x:y] for o, x, y in zip(self.order, left[:, j].tolist(), lo[:, q].tolist())]
                added += [o[x:y] for o, x, y in zip(self.order, hi[:, q].tolist(), right[:, j].tolist())]
                count[q] += np.bincount(np.concatenate(added), minlength=n)
                passed = np.flatnonzero(count[q] > SHARE * m)
                if len(passed) >= enough or right[:, j].min() == n and left[:, j].max() == 0:
                    out[q] = passed
                else:
                    left_out.append(q)
            lo[:, open_], hi[:, open_] = left, right
            open_, width = np.array(left_out, np.int64), width * GROW
        return out

    def nearest(self, query: int, q: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, float]]:
        score = cosine(self.x[c], self.norm[c], q)
        top = c if len(c) <= k + 1 else c[score >= np.partition(score, -(k + 1))[-(k + 1)]]
        score = dict(zip(c.tolist(), score.tolist()))
        out: list[tuple[int, float]] = []
        for v in top.tolist():  # of equal vectors the k + 1 smallest ids suffice
            out += [(int(i), score[v]) for i in self.ids[self.members[self.ends[v] : self.ends[v + 1]][: k + 1]] if i != query]
        return sorted(out, key=lambda r: (-r[1], r[0]))[:k]


def cosine(x: np.ndarray, norm: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (x @ q) / (norm * np.sqrt((q * q).sum()))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each query (vec_id, embedding)."""
    bounded_batches(vectors.sparkSession)
    spark = vectors.sparkSession
    rows, asked = usable(vectors), usable(queries)
    dims = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dims:
        return empty
    dim, n = dims[0]["dim"], dims[0]["count"]
    rows, asked = rows.where(F.col("dim") == dim), asked.where(F.col("dim") == dim)
    lines = np.random.default_rng(seed).standard_normal((dim, PROJECTIONS))
    blocks = max(1, -(-n // BLOCK))
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "embedding").repartition(blocks, "block").sortWithinPartitions("block")

    def part(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q = sent.value
            q = _scaled(q)
            at = _unit(q) @ lines
            held: list[pa.RecordBatch] = []

            def answer() -> pa.RecordBatch:
                t = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                block = Block(t.column(1).to_numpy(), _vectors(t.column(2).combine_chunks() if isinstance(t.column(2), pa.ChunkedArray) else t.column(2)), lines)
                out = []
                for lo in range(0, len(qid), 128):
                    for i, x, c in zip(qid[lo:].tolist(), q[lo:], block.candidates(at[lo : lo + 128], k)):
                        out += [(i, v, s) for v, s in block.nearest(i, x, c, k)]
                return pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t_) for j, t_ in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

            for b in batches:
                if not b.num_rows:
                    continue
                ids = b.column(0).to_numpy()
                cut = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
                if held and held[-1].column(0)[-1].as_py() != ids[0]:
                    yield answer()
                for lo, hi in zip(cut[:-1], cut[1:]):
                    if lo:
                        yield answer()
                    held.append(b.slice(lo, hi - lo))
            if held:
                yield answer()

        return run

    out, qid, q = None, [], []

    def ask():
        nonlocal out
        sent = spark.sparkContext.broadcast((np.array(qid), np.array(q)))
        found = dealt.mapInArrow(part(sent), "query_id long, vec_id long, score double")
        out = found if out is None else out.union(found)
        qid.clear()
        q.clear()

    for r in asked.select("vec_id", "embedding").dropDuplicates(["vec_id"]).toLocalIterator():
        qid.append(r[0])
        q.append(r[1])
        if len(qid) == QUERIES:
            ask()
    if qid:
        ask()
    if out is None:
        return empty
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_every_50th(vectors: DataFrame, k: int = 5) -> DataFrame:
    return search(vectors, vectors.where("vec_id % 50 = 0"), k)
