"""Heads of chains whose reads mostly lie together: each part contracts its own stretches of chains
in one task, and only links that leave a part are doubled.

A read's ``home`` is the part it is dealt to. Copies have the home of their first copy, so that a chain
that goes from copy to copy stays in one part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.operators.assemble import chain_heads, doubled_heads
from helixmill.operators.ordering import unsized
from helixmill.plans.storage import Store

PART_READS = 1 << 18  # reads of a part
LAST, NEAR, FAR, ENTERED = range(4)  # of rows dealt: no next read, one of this part, of another; a link from another part
PLACED, CYCLIC, PENDING, BORDER, EXIT = range(5)  # of rows found
_FOUND = "kind int, id long, head long, dist long, next long, off int"


def home_of(read_id: Column, width: int, parts: int) -> Column:
    """The part of a read without copies before it: reads of ``width`` ids in a row have one."""
    return F.pmod(F.hash(F.floor(read_id / width).cast("long")), F.lit(parts))


def heads(store: Store, nodes: DataFrame, parts: int, width: int) -> tuple[DataFrame, DataFrame]:
    """((read_id, head, dist), (read_id, label, next, off)): placed reads, and reads on cycles with the
    smallest id of their cycle. ``nodes`` (read_id, next, off, home) has every read once; links of
    offset 0 lead to copies, others to reads that are their own first copy."""
    there = F.when(F.col("off") == 0, F.col("home")).otherwise(home_of(F.col("next"), width, parts))
    kind = F.when(F.col("next").isNull(), LAST).when(there == F.col("home"), NEAR).otherwise(FAR)
    rows = nodes.select("*", there.alias("there"), kind.alias("kind"))

    def row(part: str, kind: Column, id_: str, other: str) -> Column:
        # the other read as what it is ahead: mostly a small number
        return F.struct(F.col(part).alias("part"), kind.cast("tinyint").alias("kind"), F.col(id_).alias("id"), (F.col(other) - F.col(id_)).alias("ahead"), F.col("off").cast("int").alias("off"))

    both = F.array(row("home", F.col("kind"), "read_id", "next"), F.when(F.col("kind") == FAR, row("there", F.lit(ENTERED), "next", "read_id")))
    dealt = rows.select(F.explode(both).alias("x")).where("x IS NOT NULL").select("x.*").repartition(parts, "part")
    found = store.save(dealt.select("kind", "id", "ahead", "off").mapInArrow(_contracted, _FOUND))
    of = lambda *kinds: found.where(F.col("kind").isin(*kinds))

    exits = of(EXIT).select(F.col("id").alias("x"), F.col("head").alias("ptr"), F.col("dist").alias("before"), F.col("off").alias("entered"))
    borders = of(BORDER).select(F.col("id").alias("read_id"), F.col("next").alias("x"), "dist", F.col("head").alias("label"))
    met = store.save(unsized(borders).join(unsized(exits), "x").select("read_id", "ptr", (F.col("dist") + F.col("before")).alias("dist"), F.lit(False).alias("done"), "label", "entered"))
    tops = met.where("entered = 0").select("ptr").distinct()
    tops = tops.select(F.col("ptr").alias("read_id"), "ptr", F.lit(0).cast("long").alias("dist"), F.lit(True).alias("done"), F.col("ptr").alias("label"))
    known, ringed = doubled_heads(store, store.save(met.drop("entered").unionByName(tops)))

    pending = of(PENDING).select(F.col("id").alias("read_id"), F.col("head").alias("top"), F.col("dist").alias("from_top"), "next", "off")
    top = lambda df: unsized(df.withColumnRenamed("read_id", "top"))
    placed = unsized(pending).join(top(known), "top").select("read_id", "head", (F.col("dist") + F.col("from_top")).alias("dist"))
    cyclic = unsized(pending).join(top(ringed), "top").select("read_id", "label", "next", "off")
    here = of(CYCLIC).select(F.col("id").alias("read_id"), F.col("head").alias("label"), "next", "off")
    return of(PLACED).select(F.col("id").alias("read_id"), "head", "dist").unionByName(placed), here.unionByName(cyclic)


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    kind, ids, ahead, off = (np.concatenate([b.column(i).fill_null(0).to_numpy(zero_copy_only=False) for b in rows]) for i in range(4))
    del rows
    came, own = kind == ENTERED, np.flatnonzero(kind != ENTERED)
    own = own[np.argsort(ids[own])]
    from_at, from_read, from_off = ids[came], (ids + ahead)[came], off[came]
    kind, ids, after, off = kind[own], ids[own], (ids + ahead)[own], off[own]
    n = len(ids)

    def place(x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(ids, x), max(n - 1, 0))
        if len(x) and (not n or (ids[at] != x).any()):
            raise RuntimeError("a link leads to a read that is not there")
        return at

    ptr, dist, near = np.arange(n), np.zeros(n, np.int64), np.flatnonzero(kind == NEAR)
    at = place(after[near])
    ptr[at], dist[at] = near, off[near]
    done = ptr == np.arange(n)
    top, least = ptr, np.arange(n)
    for _ in range(n.bit_length() + 1):
        move = np.flatnonzero(~done)
        if not len(move):
            break
        to = top[move]
        # on a cycle distances mean nothing and only have to stay in range
        new = (dist[move] + dist[to]) % (1 << 60), np.minimum(least[move], least[to]), done[to], top[to]
        dist[move], least[move], done[move], top[move] = new
    entered = np.zeros(n, bool)
    from_at = place(from_at)
    entered[from_at] = True
    least_of = ids.copy()
    np.minimum.at(least_of, top[done], ids[done])
    pending = done & entered[top]

    def rows_of(what: int, id_: np.ndarray, head: np.ndarray, dist: np.ndarray, next_: np.ndarray | None = None, off: np.ndarray | None = None) -> pa.RecordBatch:
        none = pa.nulls(len(id_), pa.int64())
        columns = [np.full(len(id_), what, np.int32), id_, head, dist]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), none if next_ is None else next_, none.cast(pa.int32()) if off is None else pa.array(off.astype(np.int32))], _names)

    def links(of: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        return pa.array(after[of], mask=kind[of] == LAST), off[of]

    fine, ring, left = np.flatnonzero(done & ~pending), np.flatnonzero(~done), np.flatnonzero(pending)
    out = np.flatnonzero(kind == FAR)
    yield rows_of(PLACED, ids[fine], ids[top[fine]], dist[fine])
    yield rows_of(CYCLIC, ids[ring], ids[least[ring]], np.zeros(len(ring), np.int64), *links(ring))
    yield rows_of(PENDING, ids[left], ids[top[left]], dist[left], *links(left))
    yield rows_of(BORDER, ids[from_at], least_of[from_at], from_off.astype(np.int64), pa.array(from_read))
    yield rows_of(EXIT, ids[out], ids[top[out]], dist[out], None, pending[out])


_names = [x.split()[0] for x in _FOUND.split(", ")]


def cut(store: Store, nodes: DataFrame, parts: int, width: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(placed reads, reads on cycles, links cut, reads on cycles after the cut) of ``nodes`` as in
    heads. As in cut_cycles the link of a cycle with the largest offset goes, of equals the one with the
    smallest s; no other chain changes, so only those of cycles are followed again."""
    placed, cyclic = heads(store, nodes, parts, width)
    cyclic = store.save(cyclic)
    link = F.struct(F.col("read_id").alias("s"), F.col("next").alias("p"), "off")
    gone = store.save(cyclic.groupBy("label").agg(F.max_by(link, F.struct("off", -F.col("read_id"))).alias("cut")).select("cut.*"))
    links = unsized(cyclic.select(F.col("read_id").alias("s"), F.col("next").alias("p"), "off")).join(unsized(gone.select("s")), "s", "left_anti")
    again, left = chain_heads(store, cyclic, links)
    return placed.unionByName(again), cyclic, gone, left
