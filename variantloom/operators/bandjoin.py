"""Range joins as equi-joins on buckets, so that no join is a nested loop, and passes over many small blocks of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_pairs(df: DataFrame, by: list[str], pos: str, reach: int, mark: str = "2") -> DataFrame:
    """Rows of ``df`` paired with those of the same ``by`` at 0 to ``reach`` beyond ``pos``; the partner's columns get the suffix ``mark``.

    A partner lies in the row's own bucket of width ``reach`` or in the next one.
    """
    width = reach + 1
    left = df.withColumn("bucket", F.explode(F.array(F.floor(F.col(pos) / width), F.floor(F.col(pos) / width) + 1)))
    right = df.select(*[F.col(c).alias(f"{c}{mark}") for c in df.columns], F.floor(F.col(pos) / width).alias("bucket2"))
    same = [F.col(c) == F.col(f"{c}{mark}") for c in by]
    cond = F.col("bucket") == F.col("bucket2")
    for c in same:
        cond = cond & c
    near = (F.col(f"{pos}{mark}") >= F.col(pos)) & (F.col(f"{pos}{mark}") - F.col(pos) <= reach)
    return left.join(right, cond & near).drop("bucket", "bucket2", *[f"{c}{mark}" for c in by])


def interval_pairs(points: DataFrame, intervals: DataFrame, by: str, pos: str, start: Column, end: Column, width: int = 100_000, tasks: int | None = None) -> DataFrame:
    """Points with every interval [start, end] of the same ``by`` that holds them. Intervals are dealt to all buckets they touch, and the buckets to so many ``tasks`` if they are given."""
    if tasks:
        points = points.repartition(tasks, F.col(by), F.floor(F.col(pos) / width)).hint("merge")
    spread = intervals.withColumn("b_start", start).withColumn("b_end", end).filter("b_start <= b_end").withColumnRenamed(by, "b_by").withColumn("b_bucket", F.explode(F.sequence(F.floor(F.col("b_start") / width), F.floor(F.col("b_end") / width))))
    inside = (F.col(by) == F.col("b_by")) & (F.floor(F.col(pos) / width) == F.col("b_bucket")) & F.col(pos).between(F.col("b_start"), F.col("b_end"))
    return points.join(spread, inside).drop("b_by", "b_bucket", "b_start", "b_end")


def by_blocks(df: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """``work`` of pandas frames that hold whole blocks (rows of equal ``keys``, which lie together): many small blocks a call, where a group each would cost a call each."""
    import pandas as pd

    def run(batches):
        held = []
        for b in batches:
            if not len(b):
                continue
            last = b[keys].iloc[-1]
            same = (b[keys].eq(last) | (b[keys].isna() & last.isna())).all(axis=1).to_numpy()
            cut = len(b) - int(same[::-1].argmin()) if not same.all() else 0
            if cut:
                yield work(pd.concat([*held, b[:cut]], ignore_index=True))
                held = [b[cut:]]
                continue
            if held:  # the block held goes on, or another begins
                before = held[0][keys].iloc[0]
                if not (last.eq(before) | (last.isna() & before.isna())).all():
                    yield work(pd.concat(held, ignore_index=True))
                    held = []
            held.append(b)
        if held:
            yield work(pd.concat(held, ignore_index=True))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
