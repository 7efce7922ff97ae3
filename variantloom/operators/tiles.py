"""Sums of products of sparse rows, worked out tile by tile.

A table of cells (row, column, value) is dealt into tiles, a block of rows by a block of
columns where those are many, and every pair of row blocks that may meet is multiplied in its own
task. A cell travels once for each pair of its row block, whereas a join of a table with itself by
column makes a row for every two cells of a column.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

COLUMNS = 4096  # of a tile, about
CHUNK = 512  # rows multiplied at once
CELLS = 1_000_000  # of a bucket, above which it is cut into blocks of columns
FILLED = 4000  # cells that a bucket should have at least
DENSER = 40  # steps of a matrix product that take as long as one pair of cells
PAIRS = 4_000_000  # of cells, multiplied at once


def _column_blocks(cell: Column, columns: int) -> Column:
    return F.pmod(F.xxhash64(cell), F.lit(max(1, -(-columns // COLUMNS)))).cast("int")


def _codes(table, name: str) -> tuple[np.ndarray, int]:
    """Numbers from 0 for a column's distinct values."""
    import pyarrow.compute as pc

    d = pc.dictionary_encode(table.column(name).combine_chunks())
    return np.asarray(d.indices, dtype=np.int64), len(d.dictionary)


def _dense(rows: np.ndarray, low: int, high: int, column: np.ndarray, value: np.ndarray, width: int) -> np.ndarray:
    """Cells of rows ``low`` to ``high`` (rows ascend) as a matrix."""
    a, b = np.searchsorted(rows, [low, high])
    out = np.zeros((high - low, width))
    out[rows[a:b] - low, column[a:b]] = value[a:b]
    return out


def _spread(rows: np.ndarray, column: np.ndarray, value, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(rows, columns, values, number of columns) of cells whose ``value`` is a list: its elements lie in columns of their own, and those of one row and column are added."""
    size = np.diff(np.asarray(value.offsets))
    start = np.zeros(count + 1, dtype=np.int64)
    np.maximum.at(start, column + 1, size)
    start = np.cumsum(start)
    nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    width = max(1, int(start[-1]))
    cell = np.repeat(rows, size) * width + start[np.repeat(column, size)] + nth
    own, at = np.unique(cell, return_inverse=True)
    return own // width, own % width, np.bincount(at, np.asarray(value.flatten()), len(own)), width


def _in_band(starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, column: np.ndarray, value: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(product, met) of every row i with rows ``starts[i]`` to ``ends[i]``, one after another; ``met`` tells that they share a column.

    Cells ascend by row. Where columns are sparse, the cells of a column are paired; where that
    would make more pairs than small matrices take steps, they are multiplied as matrices.
    """
    n = len(starts)
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    product, met = np.zeros(at[-1]), np.zeros(at[-1], dtype=bool)
    order = np.lexsort((rows, column))
    r, place = rows[order], column[order] * (len(starts) + 1) + rows[order]
    last = np.searchsorted(place, column[order] * (n + 1) + ends[r])
    number = np.where(ends[r] > starts[r], last - np.arange(len(r)), 0)
    if number.sum() <= (at[-1] + CHUNK * n) * max(1, width) / DENSER:
        x = value[order]
        done = np.concatenate([[0], np.cumsum(number)])
        low = 0
        while low < len(r):
            high = max(low + 1, int(np.searchsorted(done, done[low] + PAIRS, "right")) - 1)
            i = np.repeat(np.arange(low, high), number[low:high])
            j = i + np.arange(len(i)) - np.repeat(done[low:high] - done[low], number[low:high])
            to = at[r[i]] + r[j] - r[i]
            if len(to):
                first, length = to.min(), to.max() + 1 - to.min()
                product[first : first + length] += np.bincount(to - first, x[i] * x[j], length)
                met[to] = True
            low = high
        return product, met
    for a in range(0, n, CHUNK):
        b = min(n, a + CHUNK)
        own = np.flatnonzero(ends[a:b] > starts[a:b])
        if not len(own):
            continue
        one = _dense(rows, a, b, column, value, width)
        end = int(ends[a:b].max())
        for c in range(a, end, CHUNK):
            d = min(end, c + CHUNK)
            two = one if (c, d) == (a, b) else _dense(rows, c, d, column, value, width)
            p, both = one @ two.T, ((one != 0).astype(np.float32) @ (two != 0).astype(np.float32).T) > 0
            i, j = np.nonzero((np.arange(c, d)[None] >= starts[a:b, None]) & (np.arange(c, d)[None] < ends[a:b, None]))
            to = at[a + i] + c + j - a - i
            product[to], met[to] = p[i, j], both[i, j]
    return product, met


def band_products(cells: DataFrame, by: list[str], row: str, column: str, value: str, reach: int, columns: int, label: str | None = None, sites: DataFrame | None = None) -> DataFrame:
    """by, (label,) row, row2, product: sum over columns of value * value of all rows 0 to ``reach`` apart that share a column.

    ``row`` is an integer place. With ``label`` a row is a place and a label, and only rows of
    one label have a product. Cells of one row and column must be one. Rows lie in buckets of
    ``reach`` + 1 places or a few times that, so that a bucket has some thousand cells; a row's
    partners are in its own bucket or the next, and only cells within ``reach`` of a bucket's
    start travel twice. A bucket of more than ``CELLS`` cells is cut into blocks of columns, at
    most ``columns`` (about how many distinct ones there are) over ``COLUMNS``.

    Rows without a common column have no result. With ``sites`` (by, (label,) row, mean, along,
    ones, n; a row for every row of the cells) all pairs within reach have one: (product - mean
    along2 - mean2 along + mean mean2 ones) / n, made where the cells meet.

    A ``value`` that is an array holds cells of as many columns of its own, those of one row and
    column adding up: they are told apart in the tile.
    """
    import pyarrow as pa

    types = dict(cells.dtypes)
    kind, spread = types[column], types[value].startswith("array")
    place = F.col(row).cast("long")
    number = F.sum(F.size(value)) if spread else F.count(F.lit(1))
    near = written(cells.groupBy(*by, F.floor(place / (reach + 1)).cast("long").alias("near")).agg(number.alias("held")), "buckets")
    told = near.agg(F.count(F.lit(1)).alias("n"), F.sum("held").alias("held")).first()
    wide = int(min(16, max(1, FILLED * told["n"] // max(1, told["held"] or 0))))
    held = near.groupBy(*by, F.floor(F.col("near") / wide).cast("long").alias("bucket")).agg(F.sum("held").alias("held"))
    most = max(1, -(-columns // COLUMNS))
    blocks = held.select(*by, "bucket", F.least(F.lit(most), F.ceil(F.col("held") / CELLS)).cast("int").alias("blocks")).filter("blocks > 1")
    blocks = F.broadcast(written(blocks, "blocks"))  # a row per crowded bucket
    crowded = not blocks.isEmpty()
    width = wide * (reach + 1)
    own = F.floor(place / width).cast("long")
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    facts = ["mean", "along", "ones", "n"] if sites is not None else []
    labels = [label] if label else []
    rows = cells.select(*by, *labels, place.alias("row"), own.alias("own"), F.col(column).alias("column"), (F.col(value) if spread else F.col(value).cast("double")).alias("value"), *[none("double", f) for f in facts])
    if sites is not None:
        rows = rows.unionByName(sites.select(*by, *labels, place.alias("row"), own.alias("own"), none(kind, "column"), none(types[value] if spread else "double", "value"), *[F.col(f).cast("double").alias(f) for f in facts]))
    dealt = rows.withColumn("bucket", F.explode(F.when(F.col("row") - F.col("own") * width < reach, F.array("own", F.col("own") - 1)).otherwise(F.array("own"))))

    def multiply(key, table):
        whole = table.filter(table.column("column").is_valid())
        side = table.filter(table.column("mean").is_valid()) if facts else whole
        place, side_place = (np.asarray(t.column("row").combine_chunks(), dtype=np.int64) for t in (whole, side))
        both = pa.concat_tables([whole.select(labels), side.select(labels)]) if label else None
        label_no = _codes(both, label)[0] if label else np.zeros(len(place) + len(side_place), np.int64)
        low = int(side_place.min()) if len(side_place) else 0
        span = int(side_place.max()) - low + 1 if len(side_place) else 1
        code = label_no * span + np.concatenate([place, side_place]) - low
        known = np.unique(code[len(place) :])
        rows = np.searchsorted(known, code[: len(place)])
        there = known[np.minimum(rows, len(known) - 1)] == code[: len(place)] if len(known) else np.zeros(len(place), dtype=bool)
        if not there.all():  # cells of rows that ``sites`` lacks
            rows, whole = rows[there], whole.filter(pa.array(there))
        label_of, places = known // span, known % span + low
        is_own = places // width == key[len(by)].as_py()
        ends = np.where(is_own, np.searchsorted(known, label_of * span + np.minimum(places + reach - low, span - 1), "right"), np.arange(len(known)))
        starts = np.arange(len(known))
        column_no, count = _codes(whole, "column")
        val = whole.column("value").combine_chunks()
        if spread:
            rows, column_no, val, count = _spread(rows, column_no, val, count)
        val = np.asarray(val)
        order = np.argsort(rows, kind="stable")
        product, met = _in_band(starts, ends, rows[order], column_no[order], val[order], count)
        i = np.repeat(starts, ends - starts)
        j = i + np.arange(len(i)) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts)
        if facts:
            first = np.empty(len(known), dtype=np.int64)
            first[np.searchsorted(known, code[len(place) :])] = np.arange(len(side))
            mean, along, ones, n = (np.asarray(side.column(f).combine_chunks())[first] for f in facts)
            if key[-1].as_py() == 0:
                product = product - mean[i] * along[j] - mean[j] * along[i] + mean[i] * mean[j] * ones[i]
                met[:] = True
            product = product / n[i]
        i, j, product = i[met], j[met], product[met]
        same = [pa.array([k.as_py()] * len(i), table.schema.field(c).type) for c, k in zip(by, key)]
        if label:
            same.append(both.column(label).combine_chunks().dictionary_encode().dictionary.take(pa.array(label_of[i])))
        return pa.Table.from_arrays([*same, pa.array(places[i]), pa.array(places[j]), pa.array(product)], [*by, *labels, row, f"{row}2", "product"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in [*by, *labels]), f"`{row}` long, `{row}2` long, product double"])
    keys = [*by, "bucket", "block"]
    if crowded:
        thin = dealt.join(blocks, [*by, "bucket"], "left_anti").withColumn("block", F.lit(0)).groupBy(*keys).applyInArrow(multiply, schema)
        full = dealt.join(blocks, [*by, "bucket"]).withColumn("block", F.explode(F.when(F.col("column").isNull(), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("column"), F.col("blocks")).cast("int"))))).drop("blocks")
        full = full.groupBy(*keys).applyInArrow(multiply, schema).groupBy(*by, *labels, row, f"{row}2").agg(F.sum("product").alias("product"))
        parts = thin.unionByName(full)
    else:
        parts = dealt.withColumn("block", F.lit(0)).groupBy(*keys).applyInArrow(multiply, schema)
    return parts.withColumn(row, F.col(row).cast(types[row])).withColumn(f"{row}2", F.col(f"{row}2").cast(types[row]))


def pair_products(cells: DataFrame, items: DataFrame, item: str, column: str, value: str, count: int, columns: int, size: int = 512) -> DataFrame:
    """(a, b, product, common), a <= b, of every two ``items``, those without a common column included; ``common`` counts the columns that both have.

    ``items`` (column ``item``, ``count`` distinct ones) are dealt by hash into blocks of about
    ``size``, and every two blocks into tasks by block of columns; a cell travels once for each
    block. The result has a row for every pair, as a matrix has: that is what it is for.
    """
    import pyarrow as pa

    blocks = max(1, -(-count // size))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    named = cells.select(F.col(item).alias("item"), F.col(column).alias("column"), F.col(value).cast("double").alias("value"), _column_blocks(F.col(column), columns).alias("part"))
    own = items.select(F.col(item).alias("item")).distinct().select("item", F.lit(None).cast(dict(cells.dtypes)[column]).alias("column"), F.lit(0.0).alias("value"), F.lit(0).alias("part"))
    dealt = named.unionByName(own).withColumn("own", block(F.col("item"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("item", "column", "value", "part", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def multiply(key, table):
        low, high, part = (k.as_py() for k in key)
        item_no, n = _codes(table, "item")
        names = table.column("item").combine_chunks().dictionary_encode().dictionary
        filled = np.asarray(table.column("column").combine_chunks().is_valid())
        home = np.zeros(n, dtype=np.int64)
        home[item_no] = np.asarray(table.column("own").combine_chunks())
        kept = table.filter(pa.array(filled))
        column_no, width = _codes(kept, "column")
        matrix = np.zeros((n, max(1, width)))
        matrix[item_no[filled], column_no] = np.asarray(kept.column("value").combine_chunks())
        one, two = np.flatnonzero(home == low), np.flatnonzero(home == high)
        p = matrix[one] @ matrix[two].T
        there = np.zeros(matrix.shape, dtype=np.float32)
        there[item_no[filled], column_no] = 1
        met = there[one] @ there[two].T
        i, j = (np.arange(len(one) * len(two)) // max(1, len(two)), np.arange(len(one) * len(two)) % max(1, len(two))) if part == 0 else np.nonzero(met)
        a, b = names.take(pa.array(one[i])), names.take(pa.array(two[j]))
        return pa.Table.from_arrays([a, b, pa.array(p[i, j]), pa.array(met[i, j].astype(np.int64))], ["a", "b", "product", "common"])

    kind = dict(items.dtypes)[item]
    parts = dealt.groupBy("low", "high", "part").applyInArrow(multiply, f"a {kind}, b {kind}, product double, common long")
    both = parts.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "product", "common", (F.col("a") <= F.col("b")).alias("up"))
    # within one block each pair comes in both orders
    inside = block(F.col("a")) == block(F.col("b"))
    return both.filter("up" if blocks == 1 else (F.col("up") | ~inside)).groupBy("a", "b").agg(F.sum("product").alias("product"), F.sum("common").alias("common"))
