"""Approximate nearest neighbours by cross-polytope hashing.

A hash rotates a vector by three rounds of random signs and fast Hadamard transforms and
names the signed axis it is nearest to. A table concatenates one or more hashes; a query
looks into the cells whose axes it is next nearest to as well (multiprobe). Queries and rows
that meet in a cell are compared on their original vectors, and the best of all cells stay.

Rows of unequal length are banded by it: within a band every row is lifted by one coordinate
to the band's length, so that nearness by angle is nearness by inner product. How many cells a
query probes isn't a fixed number: a sample of the queries is searched exactly, and the
probes are as many as the tables need to find its neighbours.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BANDS = 16  # of length, a factor of sqrt(2) each; all shorter rows are in the last


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v: array<double>) of rows whose id is set and whose vector is not null, empty or zero and has finite components only.

    An inner product needs vectors of one length: those whose length is not the commonest one
    (ties: the longest) take no part.
    """
    v = F.col(vector_col)
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("v") == (dims["d"] if dims else 0))


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2)
        x = x.reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


class CrossPolytope:
    """``tables`` x ``hashes`` pseudo-rotations of ``dim`` dimensions, drawn from ``seed``.

    ``norm``: None if all vectors have one length, else the largest length; rows are then
    banded by length and lifted.
    """

    def __init__(self, dim: int, tables: int, hashes: int, seed: int = 7, norm: float | None = None):
        self.dim, self.tables, self.hashes, self.norm = dim, tables, hashes, norm
        self.width = 1 << max(1, math.ceil(math.log2(max(2, dim + (norm is not None)))))
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, hashes, 3, self.width))

    def bands(self, x: np.ndarray) -> np.ndarray:
        if self.norm is None:
            return np.zeros(len(x), np.int64)
        return np.clip(np.floor(2 * np.log2(self.norm / np.linalg.norm(x, axis=1)) + 1e-9), 0, BANDS - 1).astype(np.int64)

    def _lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        length = np.linalg.norm(x, axis=1, keepdims=True)
        if query or self.norm is None:
            out[:, : self.dim] = x / length
        else:
            share = np.minimum(1.0, length / (self.norm * 2.0 ** (-self.bands(x)[:, None] / 2)))
            out[:, : self.dim] = x / length * share
            out[:, self.dim] = np.sqrt(1 - share[:, 0] ** 2)
        return out

    def _rotated(self, x: np.ndarray, t: int, h: int) -> np.ndarray:
        for s in self.signs[t, h]:
            x = _hadamard(x * s)
        return x

    def cells(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables): the cell of each row in each table, bands aside."""
        x, out = self._lift(x, False), np.zeros((len(x), self.tables), dtype=np.int64)
        for t in range(self.tables):
            for h in range(self.hashes):
                y = self._rotated(x, t, h)
                axis = np.abs(y).argmax(axis=1)
                out[:, t] = out[:, t] * 2 * self.width + 2 * axis + (y[np.arange(len(y)), axis] < 0)
        return out

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        """(rows, tables, count): the cells whose axes are nearest to each query, nearest first; -1 where there are no more."""
        x = self._lift(x, True)
        count = min(count, (2 * self.width) ** self.hashes)
        out = np.full((len(x), self.tables, count), -1, dtype=np.int64)
        each = min(2 * self.width, count)
        combos = np.array(_near_first(each, self.hashes, count))
        for t in range(self.tables):
            names, gaps = [], []
            for h in range(self.hashes):
                y = self._rotated(x, t, h)
                both = np.stack([y, -y], axis=2).reshape(len(y), -1)
                first = np.argsort(-both, axis=1, kind="stable")[:, :each]
                top = np.take_along_axis(both, first, axis=1)
                names.append(first)
                gaps.append((top[:, :1] - top) ** 2)
            for a in range(0, len(x), 64):
                code = np.zeros((len(x[a : a + 64]), len(combos)), dtype=np.int64)
                gap = np.zeros(code.shape)
                for h in range(self.hashes):
                    code = code * 2 * self.width + names[h][a : a + 64][:, combos[:, h]]
                    gap += gaps[h][a : a + 64][:, combos[:, h]]
                best = np.argsort(gap, axis=1, kind="stable")[:, :count]
                out[a : a + 64, t, : best.shape[1]] = np.take_along_axis(code, best, axis=1)
        return out


def _near_first(each: int, hashes: int, count: int) -> list[tuple[int, ...]]:
    """Combinations of one rank per hash that can be among the first ``count``: no more than that many lie at or below them in every rank."""
    if hashes == 1:
        return [(i,) for i in range(each)]
    return [(i, *rest) for i in range(each) for rest in _near_first(min(each, count // (i + 1)), hashes - 1, count // (i + 1))]


def _best_pairs(q: np.ndarray, v: np.ndarray, ids: np.ndarray, qids: np.ndarray, of: np.ndarray, at: np.ndarray, k: int):
    """(query, row, score) of each query's k best among pairs (of: query, at: row): scores summed in component order, so that a pair's is the same wherever it is met."""
    score = np.zeros(len(of))
    for i in range(q.shape[1]):
        score += q[of, i] * v[at, i]
    other = qids[of] != ids[at]
    of, at, score = of[other], at[other], score[other]
    order = np.lexsort((ids[at], -score, of))
    of, at, score = of[order], at[order], score[order]
    first = np.searchsorted(of, of, "left")
    keep = np.arange(len(of)) - first < k
    return of[keep], at[keep], score[keep]


_FOUND = "query_id long, vec_id long, score double"


def _frame(parts: list, ids: np.ndarray, qids: np.ndarray):
    import pandas as pd

    cols = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3)]
    return pd.DataFrame({"query_id": qids[cols[0]], "vec_id": ids[cols[1]], "score": cols[2].astype(np.float64)})


def _met_in_cells(k: int, most: int = 1 << 20):
    """Of queries (id, v, cells) and rows (id, cell, v) of one part: each query's k best of the rows in its cells."""
    import pandas as pd

    def compare(_, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return _frame([], np.zeros(0, np.int64), np.zeros(0, np.int64))
        rows = rows.sort_values("cell", kind="stable")
        cell, ids, v = rows["cell"].to_numpy(), rows["id"].to_numpy(), np.stack(rows["v"].to_numpy()).astype(np.float64)
        qids, q = queries["id"].to_numpy(), np.stack(queries["v"].to_numpy()).astype(np.float64)
        size = np.array([len(c) for c in queries["cells"]])
        asked, owner = np.concatenate(queries["cells"].to_numpy()), np.repeat(np.arange(len(qids)), size)
        low, high = np.searchsorted(cell, asked, "left"), np.searchsorted(cell, asked, "right")
        owner, low, n = owner[high > low], low[high > low], (high - low)[high > low]
        total, parts, a = np.concatenate([[0], np.cumsum(n)]), [], 0
        while a < len(n):  # pieces of about ``most`` pairs; a query cut in two gives its best of both
            b = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
            at = np.repeat(low[a:b] - (total[a:b] - total[a]), n[a:b]) + np.arange(total[b] - total[a])
            parts.append(_best_pairs(q, v, ids, qids, np.repeat(owner[a:b], n[a:b]), at, k))
            a = b
        return _frame(parts, ids, qids)

    return compare


def _all_pairs(k: int, qids: np.ndarray, q: np.ndarray):
    """Of batches of rows: each of a few queries' k best, by full comparison."""

    def run(batches):
        for b in batches:
            ids, v = b["id"].to_numpy(), np.stack(b["v"].to_numpy()).astype(np.float64)
            for a in range(0, len(ids), 8192):
                n = len(ids[a : a + 8192])
                of, at = np.repeat(np.arange(len(qids)), n), np.tile(np.arange(n), len(qids))
                part = _best_pairs(q, v[a : a + 8192], ids[a : a + 8192], qids, of, at, k)
                yield _frame([part], ids[a : a + 8192], qids)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def probes_for(model: CrossPolytope, rows: DataFrame, asked: DataFrame, k: int, recall: float, sample: int = 64, most: int = 4096) -> int:
    """How many cells of each table to probe so that a sample of the queries finds the share ``recall`` of its true neighbours.

    At most ``sample`` queries, those with the least hashes, are searched exactly: one pass
    over the rows. For each neighbour the tables tell at which probe they would meet it.
    """
    few = asked.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    if not few:
        return 1
    qids, q = np.array([r["id"] for r in few]), np.array([r["v"] for r in few], dtype=np.float64)
    near = _best(rows.mapInPandas(_all_pairs(k, qids, q), _FOUND), k).select("query_id", F.col("vec_id").alias("id"))
    near = near.join(rows, "id").collect()
    if not near:
        return 1
    v = np.array([r["v"] for r in near], dtype=np.float64)
    order = model.probes(q, most)
    own, place = model.cells(v), {i: n for n, i in enumerate(qids.tolist())}
    needed = []
    for n, r in enumerate(near):
        hit = order[place[r["query_id"]]] == own[n][:, None]
        needed.append(int(np.where(hit.any(axis=1), hit.argmax(axis=1), order.shape[2]).min()))
    return min(order.shape[2], sorted(needed)[max(0, math.ceil(recall * len(needed)) - 1)] + 1)


def ann_search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int | None = None,
    hashes: int | None = None,
    probes: int | None = None,
    recall: float = 0.96,
    part_rows: int = 32_768,
    seed: int = 7,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best found by inner product in double precision, ties to the smaller id.

    A query never returns its own id; with fewer than k others, all of them: queries that
    their cells leave short are compared with every row. Unusable vectors (see
    :func:`usable`) take no part on either side; repeated rows count once; empty inputs give
    an empty result.

    ``probes`` defaults to as many as :func:`probes_for` finds for ``recall``. ``hashes`` a
    table defaults to one up to 4,000 rows, two while cells then hold some thousands, else
    three; ``tables`` to 6 or 14. Of rows with one and the same vector only the k + 1 smallest
    ids are indexed: under these ties no other can be returned. The cells of a table are
    dealt to parts of about ``part_rows`` rows; a part that is larger, be it one cell, is
    dealt out to several tasks, and so are its queries.
    """
    import pandas as pd

    rows = usable(vectors, id_col, vector_col).distinct()
    asked = materialize(usable(queries, id_col, vector_col).distinct(), "ann-queries")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("nth") <= k + 1).drop("nth")
    rows = materialize(rows, "ann-rows")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("hi"), F.min(length).alias("lo"), F.max(F.size("v")).alias("d")).first()
    n, d = facts["n"], facts["d"]
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = asked.filter(F.size("v") == d)
    norm = None if facts["hi"] - facts["lo"] <= 1e-5 * facts["hi"] else float(facts["hi"])
    if hashes is None:
        hashes = 1 if n < 4_000 else 2 if n < 20_000 * (2 * d) ** 2 else 3
    tables = tables or (6 if hashes == 1 else 14)
    model = CrossPolytope(d, tables, hashes, seed, norm)
    if probes is None:
        probes = probes_for(model, rows, asked, k, recall)
    bands = sorted(r["band"] for r in rows.mapInPandas(lambda it: (pd.DataFrame({"band": np.unique(model.bands(np.stack(b["v"].to_numpy())))}) for b in it if len(b)), "band long").distinct().collect()) if norm else [0]
    parts = max(1, -(-n // part_rows))

    def dealt(codes: np.ndarray) -> np.ndarray:
        """The part of each cell."""
        with np.errstate(over="ignore"):
            return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts

    def place(batches):
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy())
                cells = model.cells(x) * BANDS + model.bands(x)[:, None]
                for t in range(tables):
                    yield pd.DataFrame({"t": t, "part": dealt(cells[:, t]), "cell": cells[:, t], "id": b["id"], "v": b["v"]})

    def probe(batches):
        for b in batches:
            for a in range(0, len(b), 256):
                few = b.iloc[a : a + 256]
                cells = model.probes(np.stack(few["v"].to_numpy()), probes)
                found = []
                for t in range(tables):
                    own = cells[:, t]
                    of, code = np.repeat(np.arange(len(few)), own.shape[1]), own.ravel()
                    of, code = of[code >= 0], code[code >= 0]
                    of, code = np.tile(of, len(bands)), np.concatenate([code * BANDS + x for x in bands])
                    part = dealt(code)
                    order = np.lexsort((part, of))
                    of, code, part = of[order], code[order], part[order]
                    edge = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (part[1:] != part[:-1])]))
                    found.append(pd.DataFrame({"t": t, "part": part[edge], "id": few["id"].to_numpy()[of[edge]], "v": [few["v"].iloc[i] for i in of[edge]], "cells": np.split(code, edge[1:])}))
                yield pd.concat(found)

    placed = materialize(rows.mapInPandas(place, "t int, part long, cell long, id long, v array<double>"), "ann-placed")
    probing = materialize(asked.mapInPandas(probe, "t int, part long, id long, v array<double>, cells array<bigint>"), "ann-probes")
    cut = lambda df, name: df.groupBy("t", "part").agg(F.ceil(F.count(F.lit(1)) / (2 * part_rows)).cast("int").alias(name))
    sizes = F.broadcast(cut(placed, "row_parts").join(cut(probing, "query_parts"), ["t", "part"]))  # a row for each table and part_rows rows
    spot = lambda own: F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
    every = lambda other: F.explode(F.sequence(F.lit(0), F.col(other) - 1))
    left = probing.join(sizes, ["t", "part"]).withColumn("qp", spot("query_parts")).withColumn("rp", every("row_parts")).select("t", "part", "rp", "qp", "id", "v", "cells")
    right = placed.join(sizes, ["t", "part"]).withColumn("rp", spot("row_parts")).withColumn("qp", every("query_parts")).select("t", "part", "rp", "qp", "id", "cell", "v")
    group = ["t", "part", "rp", "qp"]
    met = _best(left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(_met_in_cells(k), _FOUND), k)
    met = materialize(met.select("query_id", "vec_id", "score"), "ann-found")
    # queries whose cells hold fewer than k others: every row, in blocks
    enough = met.groupBy("query_id").count().filter(F.col("count") >= min(k, max(0, n - 1))).select("query_id")
    short = asked.join(enough, F.col("id") == F.col("query_id"), "left_anti")
    blocks = max(1, -(-n // part_rows))
    block = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("cell", F.lit(0).cast("long"))
    each = short.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).withColumn("cells", F.array(F.lit(0).cast("long")))
    rest = each.groupBy("block").cogroup(block.groupBy("block")).applyInPandas(_met_in_cells(k), _FOUND) if not short.isEmpty() else None
    found = met if rest is None else met.unionByName(rest)
    return _best(found, k).select("query_id", "rank", "vec_id", "score")
