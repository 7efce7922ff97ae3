"""Vectors as short codes: Lloyd's k-means for each part of a vector, in integers, maintained by deltas.

Every part position has a codebook. A round assigns each part to the nearest entry and moves the
entries to the means of their parts. What a round keeps is a table of rows with the codes given
so far, and the running count and component sums of every entry. Of the next round only the
parts that change their entry matter: each is taken from the old entry's sums and added to the
new one's. Tasks sum these contributions before the shuffle, so that it holds at most a row
per task and entry; nothing else of a round is shuffled. All sums are integers, so the order of
rows and tasks can't change a result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, materialize

LARGEST = 1 << 25  # components are held within this, so that squared distances stay exact
EXACT = 1 << 52


@dataclass
class PartCodes:
    """``rows``: id, label, code, error of every kept row; ``codebooks``: int64 [parts, entries, width], the final ones."""

    rows: DataFrame
    codebooks: np.ndarray

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()

    def decoded(self, code: str) -> list[int]:
        """The vector that ``code`` stands for."""
        return [int(x) for p, book in enumerate(self.codebooks) for x in book[int(code[2 * p : 2 * p + 2], 16)]]


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, scale: int) -> DataFrame:
    """(id, label, v: array<int>) of rows whose vector is not null and has finite components only; v = floor(scale * x)."""
    x = F.col("v")
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int"))
    return rows.filter(fine).select("id", "label", whole.alias("v"))


def _matrix(column, dims: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of ``dims`` integers; short ones end in zeros."""
    offsets = np.asarray(column.offsets, dtype=np.int64)
    flat = np.asarray(column.values)[offsets[0] : offsets[-1]].astype(np.int64)
    size = np.diff(offsets)
    if len(size) and (size == dims).all():
        return flat.reshape(len(size), dims)
    out = np.zeros((len(size), dims), dtype=np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - (offsets[:-1] - offsets[0])[row]] = flat
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry of ``book`` nearest to each row of ``x``, squared distance); of equally near ones the first. Exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)), 1)
    kind = np.float64 if 4 * most * most * x.shape[1] < EXACT else np.int64
    a, b = x.astype(kind), book.astype(kind)
    gap = (b * b).sum(1) - 2 * (a @ b.T)
    found = gap.argmin(1)
    best = gap[np.arange(len(a)), found] + (a * a).sum(1)
    return found, best.astype(np.int64)


def _assign(books: np.ndarray, rows_at_once: int = 4096):
    """Rows (id, label, v, code) to (id, label, v, before, code, error): a byte for each part in ``code``."""
    import pyarrow as pa

    parts, _, width = books.shape

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                b = batch.slice(at, rows_at_once)
                x = _matrix(b.column(2), parts * width)
                code, error = np.zeros((len(x), parts), dtype=np.uint8), np.zeros(len(x), dtype=np.int64)
                for p in range(parts):
                    code[:, p], far = nearest(x[:, p * width : (p + 1) * width], books[p])
                    error += far
                codes = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), codes, pa.array(error)], ["id", "label", "v", "before", "code", "error"])

    return run


def _moves(parts: int, entries: int, width: int):
    """Rows (v, before, code) to the sums of what each entry gains and loses in this task: (part, entry, n, s0, s1, ...)."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros((parts, entries, width + 1), dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), parts * width)
            before, code = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            new = np.frombuffer(b"".join(code), dtype=np.uint8).reshape(len(x), parts)
            known = np.array([c is not None for c in before], dtype=bool)
            old = np.frombuffer(b"".join(c if c is not None else bytes(parts) for c in before), dtype=np.uint8).reshape(len(x), parts)
            for p in range(parts):
                moved = ~known | (old[:, p] != new[:, p])
                own = np.concatenate([np.ones((len(x), 1), dtype=np.int64), x[:, p * width : (p + 1) * width]], axis=1)
                np.add.at(total[p], new[moved, p], own[moved])
                left = moved & known
                np.subtract.at(total[p], old[left, p], own[left])
        p, e = np.nonzero(total.any(axis=2))
        columns = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), *(pa.array(total[p, e, i]) for i in range(width + 1))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", *(f"s{i}" for i in range(width))])

    return run


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = None, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> PartCodes:
    """Codes of all rows whose vector is not null and holds neither nulls nor non-finite components.

    A component x counts as floor(scale * x), held within 2^25 of zero. Vectors are cut into
    ``parts`` consecutive parts of one width; where lengths differ or aren't a multiple of
    ``parts``, vectors end in zeros up to the next multiple of the longest one's length. A
    codebook starts as the parts of the ``entries`` rows (at most 256) with the smallest ids
    (null ids last; rows of one id by their vectors), and is as small as the table if that has
    fewer rows. Rows alike are separate rows. An empty table gives no rows and empty codebooks.

    A round's state (rows with their codes) and the entries' running sums lie in the shared
    folder, those of the round before are deleted: lost executors cost a task, not a round.
    Only codebooks and sums, which don't grow with the table, reach the driver.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part: 1 to 256 entries")
    state = materialize(integers(vectors, id_col, vector_col, label_col, scale).withColumn("code", F.lit(None).cast("binary")), "codes-rows")
    longest = state.agg(F.max(F.size("v"))).first()[0]
    width = max(1, -(-(longest or 0) // parts))
    seeds = [r["v"] for r in state.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    books = np.zeros((len(seeds), parts * width), dtype=np.int64)
    for row, v in zip(books, seeds):
        row[: len(v)] = v
    books = np.ascontiguousarray(books.reshape(len(seeds), parts, width).transpose(1, 0, 2))
    names = ["n", *(f"s{i}" for i in range(width))]
    schema = "id long, label string, v array<int>, before binary, code binary, error long"
    sums = None

    def assigned(name: str) -> DataFrame:
        return materialize(state.mapInArrow(_assign(books), schema), name)

    if seeds:
        for n in range(rounds):
            told = assigned(f"codes-{n}")
            drop_written(state)
            changed = told.filter(F.col("before").isNull() | (F.col("before") != F.col("code"))).select("v", "before", "code")
            moves = changed.mapInArrow(_moves(parts, len(seeds), width), ", ".join(["part int", "entry int", *(f"{c} long" for c in names)]))
            both = moves if sums is None else moves.unionByName(sums)
            kept = materialize(both.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names]), f"codes-sums-{n}")
            if sums is not None:
                drop_written(sums)
            sums = kept
            for r in sums.filter("n > 0").collect():  # at most parts * entries rows
                books[r["part"], r["entry"]] = np.array(r[3:], dtype=np.int64) // r["n"]
            state = told.select("id", "label", "v", "code")
    last = assigned("codes-last")
    drop_written(state)
    text = F.lower(F.hex("code"))
    return PartCodes(last.select("id", "label", text.alias("code"), "error"), books)


def with_label_errors(rows: DataFrame, few: int = 20_000, salts: int = 64) -> DataFrame:
    """``rows`` with label_error: the sum of ``error`` over rows of the same label, nulls together.

    Labels are summed first. Up to ``few`` sums are broadcast, their number being counted; more
    are joined by label and salt, so that a frequent label's rows are dealt over ``salts`` tasks.
    """
    sums = materialize(rows.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "codes-labels")
    same = F.col("label").eqNullSafe(F.col("of_label"))
    if sums.count() <= few:
        return rows.join(F.broadcast(sums), same).drop("of_label")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(salts)))
    copies = sums.withColumn("of_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(copies, same & (F.col("salt") == F.col("of_salt"))).drop("of_label", "of_salt", "salt")
