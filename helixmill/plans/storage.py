"""Tables between the steps of iterative plans, in the folder all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share. Where it is unset, a temporary
    folder serves a session on one machine; any other is refused."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="helixmill-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


class Store:
    """Writes a table, hands back one that reads it: lineage ends there, and a lost
    executor costs only its running tasks."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.base, self.n = spark, f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex[:12]}", 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(path := f"{self.base}/{self.n}")
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stored = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        for df in dfs:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(df._stored)
            p.getFileSystem(conf).delete(p, True)
