"""Ranks, medians and running sums without a task that sorts a whole group.

Rows are dealt by ranges of (group, order), so that a large group lies in many tasks one after
another. The sums of the ranges, a row per group and range, tell where each range starts; within a
range a window counts on from there. Of equal values only one row with their number is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def running(df: DataFrame, by: list[str], order: list[str | Column], weight: Column | None = None, before: str = "before", total: str = "total") -> DataFrame:
    """``df`` with ``before``, the sum of ``weight`` (1 if none is given) over the rows of the same ``by`` ahead in ``order``, and ``total``, that over all of them.

    Rows alike in ``by`` and ``order`` must be interchangeable, or ordered by one more column.
    Null keys are keys of their own.
    """
    w = F.lit(1).cast("long") if weight is None else weight
    keys = [f"key_{i}" for i in range(len(by))]
    told = df.withColumns({k: F.to_json(F.struct(F.col(c).alias("k"))) for k, c in zip(keys, by)}) if by else df
    ranges = written(told.withColumn("own", w).repartitionByRange(*keys, *order).withColumn("part", F.spark_partition_id()), "ranges")
    ahead = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy(*keys, "part").agg(F.sum("own").alias("in_part"))
    starts = sums.select(*keys, "part", F.coalesce(F.sum("in_part").over(ahead), F.lit(0)).alias("start"), F.sum("in_part").over(Window.partitionBy(*keys)).alias(total))
    within = Window.partitionBy(*keys, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranges.join(F.broadcast(starts), [*keys, "part"])  # a row per group and range
    return out.withColumn(before, F.col("start") + F.coalesce(F.sum("own").over(within), F.lit(0))).drop(*keys, "part", "own", "start")


def value_ranks(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, value, ties, before, total: each distinct value with how many rows have it, how many a smaller one, and how many any. Null values are left out."""
    values = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"))
    return running(values, by, [value], F.col("ties"))


def element(df: DataFrame, value: str, by: list[str], at: dict[str, Column]) -> DataFrame:
    """by, total and for every name of ``at`` the element of the sorted values at that place (from 0; an expression of ``total``)."""
    r = value_ranks(df, value, by)
    here = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("ties")), F.col(value)))
    return r.groupBy(*by).agg(F.max("total").alias("total"), *[here(k).alias(n) for n, k in at.items()])
