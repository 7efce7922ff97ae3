"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into m segments of about log2(rows) bits. A search grows the radius of the
segments step by step: once every segment has been probed at radius r and the first j of them
at r + 1, every code within Hamming distance m * (r + 1) + j - 1 has been met (pigeonhole).
A query is finished when that bound reaches the distance of its k-th verified neighbour.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def sign_code(embedding: str, bits: int = 64):
    """A bigint code of the first ``bits`` (64 at most) components: bit i is set if component i is positive."""
    parts = [F.when(F.element_at(F.col(embedding), i + 1) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long") for i in range(bits)]
    code = F.shiftleft(parts[0], 0)
    for i, p in enumerate(parts[1:], 1):
        code = code.bitwiseOR(F.shiftleft(p, i))
    return code


def _segments(bits: int, rows: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    m = max(1, math.ceil(bits / max(1.0, math.log2(max(2, rows)))))
    edge = [round(i * bits / m) for i in range(m + 1)]
    return [(edge[i], edge[i + 1] - edge[i]) for i in range(m)]


def _value(code: str, start: int, width: int):
    return F.shiftrightunsigned(F.col(code), start).bitwiseAND(F.lit((1 << width) - 1))


def _around(code: str, start: int, width: int, radius: int):
    """Every segment value at exactly ``radius`` bits from the code's own."""
    masks = ",".join(f"{sum(1 << b for b in c)}L" for c in combinations(range(width), radius))
    own = _value(code, start, width)
    return F.transform(F.expr(f"array({masks})"), lambda mask: own.bitwiseXOR(mask))


def hamming_topk(codes: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64, id_col: str = "id", code_col: str = "code") -> DataFrame:
    """query_id, rank, id, distance: for each query its k nearest other ids, nearest first, ties to the smaller id.

    Both inputs hold (id, code: bigint). Rows with a null id or code take no part; repeated
    rows count once; a query never returns its own id; with fewer than k others, all of them
    are returned. Empty inputs give an empty result.

    Rows of one code are represented by that code and their k + 1 smallest ids (no other can
    be among k under these ties), so a code shared by many rows is no hot key. The loop runs
    over radii, at most ``bits`` steps; a step reads one row (how many queries are left).
    """
    spark = codes.sparkSession
    rows = codes.select(F.col(id_col).cast("long").alias("id"), F.col(code_col).cast("long").alias("code")).dropna().distinct()
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("nth") <= k + 1)
    members = materialize(ranked.drop("nth"), "mih-members")
    asked = materialize(queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(code_col).cast("long").alias("qcode")).dropna().distinct(), "mih-queries")
    weights = members.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    n_codes, n_rows = weights.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    segs = _segments(bits, n_codes)
    index = materialize(
        weights.select("code", "n", F.explode(F.array(*[F.struct(F.lit(j).alias("seg"), _value("code", a, w).alias("value")) for j, (a, w) in enumerate(segs)])).alias("s")).select("s.seg", "s.value", "code", "n"),
        "mih-index",
    )
    need = min(k + 1, n_rows)
    left = asked.select("qcode", F.lit(bits).alias("bound")).distinct()
    kept = spark.createDataFrame([], "qcode long, code long, distance int, n long")
    done = None
    widest = max(w for _, w in segs)
    steps: list[tuple[list[int], int]] = []
    for r in range(widest + 1):
        probed = [j for j, (_, w) in enumerate(segs) if r <= w]
        steps += [(probed, r)] if r < 3 else [([j], r) for j in probed]
    radius = [-1] * len(segs)
    distance = F.bit_count(F.col("qcode").bitwiseXOR(F.col("code"))).cast("int")
    for probed, r in steps:
        probes = [F.struct(F.lit(j).alias("seg"), _around("qcode", *segs[j], r).alias("values")) for j in probed]
        hits = (
            left.select("qcode", "bound", F.explode(F.array(*probes)).alias("p"))
            .select("qcode", "bound", F.col("p.seg").alias("pseg"), F.explode("p.values").alias("pvalue"))
            .join(index, (F.col("seg") == F.col("pseg")) & (F.col("value") == F.col("pvalue")) & (distance <= F.col("bound")))
            .select("qcode", "code", distance.alias("distance"), "n")
        )
        for j in probed:
            radius[j] = r
        covered = bits if all(x >= w for x, (_, w) in zip(radius, segs)) else sum(x + 1 for x in radius) - 1
        nearer = Window.partitionBy("qcode").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
        found = kept.unionByName(hits).distinct().withColumn("nearer", F.coalesce(F.sum("n").over(nearer), F.lit(0))).filter(F.col("nearer") < need).drop("nearer")
        found = materialize(found, "mih-found")
        sure = found.filter(F.col("distance") <= covered).groupBy("qcode").agg(F.sum("n").alias("sure")).filter(F.col("sure") >= need).select("qcode")
        finished = found.join(sure, "qcode", "left_semi")
        done = finished if done is None else done.unionByName(finished)
        kept = found.join(sure, "qcode", "left_anti")
        # what is farther than the k-th verified distance so far need not be met any more
        reached = kept.groupBy("qcode").agg(F.sum("n").alias("met"), F.max("distance").alias("farthest"))
        rest = left.join(sure, "qcode", "left_anti").join(reached, "qcode", "left")
        left = materialize(rest.select("qcode", F.when(F.col("met") >= need, F.col("farthest")).otherwise(F.col("bound")).alias("bound")), "mih-left")
        if left.isEmpty():
            break
    best = asked.join(done, "qcode").join(members, "code").filter(F.col("id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    once = best.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
