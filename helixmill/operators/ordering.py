"""Numbers, neighbours and running sums in a global order without a single-task window.

Rows are cut into buckets by a monotone function of the order column. A window runs
inside (key, bucket); what crosses a border comes from one row per (key, bucket), of
which ``FAN`` make a bucket again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


FAN = 4096


def unsized(df: DataFrame) -> DataFrame:
    """One side of a join whose size is not known beforehand, as it comes of an explode, a filter
    or a join: both sides are sorted, as Spark's estimate would have it broadcast unchecked."""
    return df.hint("merge")


def bucket(order: str, width: int) -> Column:
    return F.floor(F.col(order) / F.lit(width)).cast("long")


def next_in_group(df: DataFrame, key: str, order: str, width: int, out: str = "next") -> DataFrame:
    """``df`` with the next value of the unique column ``order`` among rows of one key, which may hold most rows."""
    b = df.withColumn("__b", bucket(order, width))
    inner = Window.partitionBy(key, "__b").orderBy(order)
    firsts = b.groupBy(key, "__b").agg(F.min(order).alias("__first")).withColumn("__b2", bucket("__b", FAN))
    outer = firsts.groupBy(key, "__b2").agg(F.min("__first").alias("__first2"))
    outer = outer.withColumn("__follow2", F.lead("__first2").over(Window.partitionBy(key).orderBy("__b2"))).drop("__first2")
    near = firsts.withColumn("__near", F.lead("__first").over(Window.partitionBy(key, "__b2").orderBy("__b")))
    following = near.join(outer, [key, "__b2"]).select(key, "__b", F.coalesce("__near", "__follow2").alias("__follow"))
    rows = b.withColumn("__n", F.lead(order).over(inner))
    return unsized(rows).join(following, [key, "__b"]).withColumn(out, F.coalesce("__n", "__follow")).drop("__b", "__n", "__follow")


def previous(df: DataFrame, value: str, order: list[str], width: int, by: list[str] = (), out: str = "previous") -> DataFrame:
    """``df`` with the value of the row before in the order of the columns ``order`` among rows of
    one ``by``, null for the first; buckets are cut from the first of them, as in running_sum."""
    by = list(by)
    b = df.withColumn("__b", bucket(order[0], width))
    lasts = b.groupBy(*by, "__b").agg(F.max_by(value, F.struct(*order)).alias("__last")).withColumn("__b2", bucket("__b", FAN))
    along = lambda key, column: (Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))).orderBy(column)
    far = lasts.groupBy(*by, "__b2").agg(F.max_by("__last", "__b").alias("__last2"))
    far = far.withColumn("__far", F.lag("__last2").over(along(by, "__b2"))).drop("__last2")
    near = lasts.withColumn("__near", F.lag("__last").over(along([*by, "__b2"], "__b")))
    border = near.join(far, [*by, "__b2"]).select(*by, "__b", F.coalesce("__near", "__far").alias("__border"))
    rows = unsized(b.withColumn("__in", F.lag(value).over(along([*by, "__b"], F.struct(*order))))).join(border, [*by, "__b"])
    return rows.withColumn(out, F.coalesce("__in", "__border")).drop("__b", "__in", "__border")


def _sum_before(df: DataFrame, value: str, by: list[str], order: str, name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def _outer(parts: DataFrame, by: list[str]) -> DataFrame:
    """(by, __b, __before): sum of the totals __t of the buckets before each."""
    parts = parts.withColumn("__b2", bucket("__b", FAN))
    outer = _sum_before(parts.groupBy(*by, "__b2").agg(F.sum("__t").alias("__t2")), "__t2", by, "__b2", "__far").drop("__t2")
    near = _sum_before(parts, "__t", [*by, "__b2"], "__b", "__near").join(outer, [*by, "__b2"])
    return near.select(*by, "__b", (F.col("__near") + F.col("__far")).alias("__before"))


def running_sum(df: DataFrame, value: Column, order: list[str], width: int, by: list[str] = (), out: str = "running", exclusive: bool = False) -> DataFrame:
    """Running sum of ``value`` in the order of the columns ``order`` (the first is cut into
    buckets). One row per FAN buckets meets in one task: totals, not rows."""
    by = list(by)
    b = df.withColumn("__v", value).withColumn("__b", bucket(order[0], width))
    parts = _outer(b.groupBy(*by, "__b").agg(F.sum("__v").alias("__t")), by)
    w = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = unsized(b.withColumn("__in", F.sum("__v").over(w))).join(parts, [*by, "__b"])
    total = F.col("__before") + F.col("__in")
    return rows.withColumn(out, (total - F.col("__v") if exclusive else total).cast("long")).drop("__v", "__b", "__in", "__before")


def dense_number(df: DataFrame, order: list[str], width: int, by: list[str] = (), out: str = "number") -> DataFrame:
    """0-based row number in the order of the columns ``order``."""
    return running_sum(df, F.lit(1), order, width, by, out, exclusive=True)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
