"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key scaled by its quality weight; within a source the
documents are ranked by key and their sizes prefix-summed against the source's budget.
Whole passes over the source (epochs) come first, the remaining budget is filled in key order.

All of it is DataFrame work. The prefix sum never puts a source into one task: keys are cut
into ranges of about ``bucket_rows`` documents, ranges are summed first, and each range is
then scanned by itself from the sum of those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed_unit


def source_targets(docs: DataFrame, source: str, size: str, weights=(1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row per source: mix_source, mix_no, n_docs, source_size, target.

    Sources are numbered by code point with null last and take ``weights`` in turn. The total
    of all sizes is shared by weight; a source that would get more than ``max_epochs`` times
    its own size stops there and the excess is shared among the others by weight again. The
    fixed point of that is found in closed form: sources in order of capacity per weight are
    capped as long as the level that the others would reach lies above that ratio.
    """
    n = len(weights)
    every, order = Window.partitionBy(), Window.orderBy(F.col("mix_source").asc_nulls_last())
    by_ratio = Window.orderBy("mix_ratio", "mix_no")
    ahead = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        docs.groupBy(F.col(source).alias("mix_source"))
        .agg(F.sum(size).cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        .withColumn("mix_no", F.row_number().over(order))
        .withColumn("mix_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("mix_no") - 1) % n + 1).cast("long"))
        .withColumn("mix_cap", F.col("source_size") * max_epochs)
        .withColumn("mix_ratio", F.col("mix_cap") / F.col("mix_w"))
    )
    zero = F.lit(0).cast("long")
    s = (
        s.withColumn("mix_total", F.sum("source_size").over(every))
        .withColumn("mix_wsum", F.sum("mix_w").over(every))
        .withColumn("mix_level", (F.col("mix_total") - F.coalesce(F.sum("mix_cap").over(ahead), zero)) / (F.col("mix_wsum") - F.coalesce(F.sum("mix_w").over(ahead), zero)))
        .withColumn("mix_capped", F.col("mix_level") > F.col("mix_ratio"))
        .withColumn("mix_capsum", F.sum(F.when(F.col("mix_capped"), F.col("mix_cap")).otherwise(zero)).over(every))
        .withColumn("mix_free", F.sum(F.when(F.col("mix_capped"), zero).otherwise(F.col("mix_w"))).over(every))
    )
    share = F.col("mix_w") * ((F.col("mix_total") - F.col("mix_capsum")) / F.col("mix_free"))
    target = F.when(F.col("mix_capped"), F.col("mix_cap").cast("double")).otherwise(F.least(share, F.col("mix_cap").cast("double")))
    return s.select("mix_source", "mix_no", "n_docs", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    size: str = "size",
    quality: str | None = None,
    tie: str | None = None,
    weights=(1, 2, 3),
    max_epochs: int = 3,
    bucket_rows: int = 20_000,
) -> DataFrame:
    """The input's rows with source_size, target, epochs and taken.

    ``size``: a long column, null counts as 0. ``quality``: a positive weight; null or not
    positive counts as 1. ``tie``: a column that orders rows of one key; rows alike in key,
    size and ``tie`` are interchangeable. ``taken`` is the number of units of that row in the
    mix, repeats counted: epochs * size, and of the remaining budget what the row gets in
    key order; the last row reached is taken in part, so each source meets its rounded target.
    A null source is a source of its own; an empty table gives an empty result; columns of
    the input named like the four results are replaced.
    """
    docs = docs.drop("source_size", "target", "epochs", "taken")
    q = F.col(quality) if quality else F.lit(1.0)
    q = F.when(q > 0, q.cast("double")).otherwise(F.lit(1.0))
    sized = docs.withColumn("mix_size", F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long")))
    per_source = source_targets(sized, source, "mix_size", weights, max_epochs)
    keyed = (
        sized.join(per_source, sized[source].eqNullSafe(per_source["mix_source"]))
        .withColumn("mix_key", -F.log(hashed_unit(F.col(key))) / q)
        .withColumn("mix_range", F.floor((1.0 - F.exp(-F.col("mix_key"))) * F.ceil(F.col("n_docs") / bucket_rows)))
    )
    before_range = Window.partitionBy("mix_no").orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        keyed.groupBy("mix_no", "mix_range")
        .agg(F.sum("mix_size").alias("mix_range_size"))
        .select("mix_no", "mix_range", F.coalesce(F.sum("mix_range_size").over(before_range), F.lit(0)).alias("mix_ahead"))
    )
    order = ["mix_key", key, "mix_size", *([tie] if tie else [])]
    within = Window.partitionBy("mix_no", "mix_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    room = budget - F.col("epochs") * F.col("source_size") - F.col("mix_ahead") - F.coalesce(F.sum("mix_size").over(within), F.lit(0))
    return (
        keyed.join(ranges, ["mix_no", "mix_range"])
        .withColumn("epochs", whole)
        .withColumn("taken", (F.col("epochs") * F.col("mix_size") + F.least(F.greatest(room, F.lit(0)), F.col("mix_size"))).cast("long"))
        .select(*docs.columns, "source_size", "target", "epochs", "taken")
    )
