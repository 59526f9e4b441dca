"""Shared plumbing: tables, scratch tables in the shared folder, text slices."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from helixmill.plans.storage import shared_folder

#: Bytes of text that the vectorised kernels look at in one go.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch on its way to Python.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes, so that long texts do not make huge ones: the session's
    limit is lowered to BATCH_BYTES where it is higher."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m")
    if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sheltered(docs: DataFrame, reserved: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns named like a ``reserved`` one renamed, and what gives a table of
    the same columns their names back."""
    taken, names = {c.lower() for c in docs.columns} | {r.lower() for r in reserved}, []
    for c in docs.columns:
        name, i = c, 0
        while c.lower() in {r.lower() for r in reserved} and name.lower() in taken:
            name, i = f"{c}_{i}", i + 1
        taken.add(name.lower())
        names.append(name)
    return docs.toDF(*names), lambda out: out.toDF(*docs.columns)


class Scratch:
    """Tables written to the shared folder to cut lineage."""

    def __init__(self, spark: SparkSession, what: str):
        bounded_batches(spark)
        self.spark, self.base = spark, f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(path := self.path(name))
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Free tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for df in dfs:
            p = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            p.getFileSystem(conf).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count or not pa.types.is_large_string(col.type):
        col = pc.fill_null(col, "").cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = col.buffers()[2]
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)
    return raw, offsets - first


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds SLICE_BYTES of text or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
