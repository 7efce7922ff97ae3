"""N-gram Jaccard join by parity sketches.

A document's distinct word shingles each flip one bit of a wide bit sketch, so the Hamming
distance of two sketches never exceeds the size of the sets' symmetric difference. Sets that
overlap by the threshold differ in at most t elements, where t follows from the size band;
the sketch is cut into blocks, and a difference spoils one block at most, so two documents
that belong together agree in all of their blocks that hold bits but t. It is therefore
enough that each document enters the join with t + 1 of its blocks, taken in one order that all
documents share (blocks known to be common last): partners must meet in one of them.
Documents that meet are compared by Hamming distance of dense sketches, and what passes is
verified on the shingle sets themselves.

Wide sketches are never laid out: a block is the XOR of the hashes of its bits. In bands of
small sets each bit is a block of its own.

Equal sets are one node throughout, whatever the number of documents that have them. Nodes
that meet in a block are linked to the block's first node and to the one before them; only
blocks whose nodes then still lie in different components are compared in full, small ones
by a join, large ones in pairs of bounded pieces. Of large blocks the nearest pairs that would
connect components come first, each node in one of its blocks at a time; all other pairs that
sketches allow are looked at only where components are still apart after that.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .graph import components
from .textbytes import bytes_of, chunks, word_hashes

SKETCH = 1024  # least bits of the dense sketch; larger sets have the next power of two of their size
TEXTS = 256  # texts that share one sort: their number takes the upper 8 bits
SINGLE = 256  # up to this size each bit is a block
KEY_BITS = 55
SQUARE = 512  # nodes of a piece compared with as many at once
_LOW56 = np.uint64((1 << 56) - 1)
_FACTORS = np.random.default_rng(5).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def shingle_sets(texts, words: int):
    """Yields (first text, number of texts, 56-bit shingle hashes, text of each): distinct and sorted within each text."""
    data, offsets = bytes_of(texts)
    for a, x, begin in chunks(data, offsets, 0, TEXTS):
        n = len(begin) - 1
        h, text = word_hashes(x, begin)
        count = np.bincount(text, minlength=n)
        first = np.cumsum(count) - count
        short = (count > 0) & (count < words)
        starts = np.where(short, 1, np.maximum(count - words + 1, 0))
        of = np.repeat(np.arange(n), starts)
        at = np.repeat(first - (np.cumsum(starts) - starts), starts) + np.arange(starts.sum())
        length = np.where(short, count, words)[of]
        s = length.astype(np.uint64)
        with np.errstate(over="ignore"):
            for j in range(words):
                inside = j < length
                s = s + np.where(inside, h[np.minimum(at + j, len(h) - 1)] if len(h) else 0, 0).astype(np.uint64) * _FACTORS[j]
        s = np.sort((of.astype(np.uint64) << np.uint64(56)) | (_mix(s) & _LOW56))
        s = s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s
        yield a, n, s & _LOW56, (s >> np.uint64(56)).astype(np.int64)


def _bands(size: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sets, band, t): the bands a set joins in, and how many blocks may differ there.

    A pair meets in the band of its smaller set: band j holds sizes 2^j to 2^(j+1) - 1. A set
    joins in its own band, and in the next lower one if a partner can be that small.
    """
    band = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
    share = percent / 100
    least = np.ceil(size * share - 1e-9).astype(np.int64)
    most = np.floor(size / share + 1e-9).astype(np.int64)
    differ = lambda total: np.floor(total * (1 - share) / (1 + share) + 1e-9).astype(np.int64)
    alone = size - np.ceil((size + least) * share / (1 + share) - 1e-9).astype(np.int64)
    all_sets = np.flatnonzero(size > 0)
    lower = np.flatnonzero((size > 1) & (least < (1 << band)))
    out = []
    for sets, b, t in ((all_sets, band, differ(size + most)), (lower, band - 1, differ(size + (1 << band) - 1))):
        t = np.where((1 << (b + 1)) <= SINGLE, alone, t)
        out.append((sets, b[sets], t[sets]))
    return out


def _blocks(h: np.ndarray, text: np.ndarray, size: np.ndarray, percent: int):
    """Yields (set, 55-bit block key, t of its set) of every block that holds bits, for each band."""
    start = np.cumsum(size) - size
    for sets, band, t in _bands(size, percent):
        if not len(sets):
            continue
        n = size[sets]
        at = np.repeat(start[sets] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        which = np.repeat(np.arange(len(sets)), n)
        bits, b = h[at], band[which].astype(np.uint64)
        wide = (np.uint64(2) << b) > SINGLE
        # a block's number: the bit itself, or one of 2^(band + 1)
        block = np.where(wide, (bits >> np.uint64(8)) & ((np.uint64(2) << b) - np.uint64(1)), bits & np.uint64((1 << 48) - 1))
        packed = (which.astype(np.uint64) << np.uint64(48)) | block
        order = np.argsort(packed)
        packed = packed[order]
        edge = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
        with np.errstate(over="ignore"):
            key = np.bitwise_xor.reduceat(_mix(bits[order] * np.uint64(3)), edge)
            key = _mix(key + (packed[edge] & np.uint64((1 << 48) - 1)) * np.uint64(0x9E3779B97F4A7C15) + band[which[order][edge]].astype(np.uint64)) >> np.uint64(64 - KEY_BITS)
        own = which[order][edge]
        yield sets[own], key, t[own]


def _node_of(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for an empty one."""
    node, filled = np.zeros(len(size), np.uint64), np.flatnonzero(size)
    if len(filled):
        edge = (np.cumsum(size) - size)[filled]
        with np.errstate(over="ignore"):
            node[filled] = _mix(np.bitwise_xor.reduceat(_mix(h), edge) + np.add.reduceat(_mix(h ^ np.uint64(0xABCDEF)), edge) * np.uint64(7) + size[filled].astype(np.uint64))
    return node.astype(np.int64)


def _fresh(node: np.ndarray, size: np.ndarray, seen: set[int]) -> np.ndarray:
    """Sets that are not empty and whose name is not in ``seen`` yet; adds them."""
    fresh = np.zeros(len(node), bool)
    for i in np.flatnonzero(size):
        if (k := int(node[i])) not in seen:
            seen.add(k)
            fresh[i] = True
    return fresh


def _sketches(h: np.ndarray, text: np.ndarray, size: np.ndarray) -> list[bytes]:
    """A parity sketch per set, as wide as the set is large, so that long texts are told apart too."""
    width = np.maximum(SKETCH, np.int64(1) << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    end = np.cumsum(width)
    at = (end - width)[text] + (h & (width[text] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(end[-1]) if len(end) else 0) & 1).astype(np.uint8)).tobytes()
    return [packed[(e - w) // 8 : e // 8] for e, w in zip(end.tolist(), width.tolist())]


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64-bit words folded by XOR to ``width`` words: the sketch that the narrower width would have given."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Hamming distance of each pair of sketches, at the narrower width of the two."""
    out, by_width = np.zeros(len(a), np.int64), {}
    for i, (x, y) in enumerate(zip(a, b)):
        by_width.setdefault((len(x), len(y)), []).append(i)
    for (wa, wb), rows in by_width.items():
        one, two = (np.frombuffer(b"".join(s[i] for i in rows), dtype=np.uint64).reshape(len(rows), -1) for s in (a, b))
        least = min(wa, wb) // 8
        out[rows] = np.bitwise_count(_fold(one, least) ^ _fold(two, least)).sum(axis=1)
    return out


def _sets(words: int, percent: int, common_in: int):
    """Per text (id, node, size, sketch); and, per batch, the block keys that many of its distinct sets have."""
    import pyarrow as pa

    schema = pa.schema([("id", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("sketch", pa.binary()), ("key", pa.int64()), ("hits", pa.int64())])

    def run(batches):
        for batch in batches:
            keys, seen = [], set()
            for a, n, h, text in shingle_sets(batch.column(1), words):
                size = np.bincount(text, minlength=n)
                node = _node_of(h, size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), pa.array(node, mask=size == 0), pa.array(size), pa.array(_sketches(h, text, size), pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=schema
                )
                fresh = _fresh(node, size, seen)
                keys += [key[fresh[sets]] for sets, key, _ in _blocks(h, text, size, percent)]
            if keys:
                k, c = np.unique(np.concatenate(keys), return_counts=True)
                k, c = k[c >= common_in], c[c >= common_in]
                none = lambda t: pa.nulls(len(k), t)
                yield pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.binary()), pa.array(k.astype(np.int64)), pa.array(c)], schema=schema)

    return run


def _entries(words: int, percent: int, common: np.ndarray):
    """(key, node, size): of each distinct set of a batch the t + 1 blocks it joins by."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            seen: set[int] = set()
            for _, n, h, text in shingle_sets(batch.column(1), words):
                size = np.bincount(text, minlength=n)
                own = _node_of(h, size)
                fresh = _fresh(own, size, seen)
                for sets, key, t in _blocks(h, text, size, percent):
                    keep = fresh[sets]
                    sets, key, t = sets[keep], key[keep], t[keep]
                    late = common[np.minimum(np.searchsorted(common, key), max(0, len(common) - 1))] == key if len(common) else np.zeros(len(key), bool)
                    order = np.lexsort((key, late, sets))
                    sets, key, t = sets[order], key[order], t[order]
                    count = np.bincount(sets, minlength=n)
                    nth = np.arange(len(sets)) - (np.cumsum(count) - count)[sets]
                    keep = nth <= t
                    yield pa.RecordBatch.from_arrays([pa.array(key[keep].astype(np.int64)), pa.array(own[sets[keep]]), pa.array(size[sets[keep]])], ["key", "node", "size"])

    return run


def _hash_lists(words: int):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for _, n, h, text in shingle_sets(batch.column(0), words):
                size = np.bincount(text, minlength=n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(h.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_node_of(h, size)), lists], ["node", "hashes"])

    return run


def _piecewise(percent: int, forest: bool):
    """Pairs of one block's pieces that lie in different components and may link by size and sketch.

    ``forest``: of those only the nearest ones that would connect the pieces' components, at
    most one less than there are nodes. Otherwise all, each in the smallest block (by key) that both nodes
    are in, so that nodes with many blocks in common are paired once.
    """
    import pandas as pd

    def fits(one, two):
        """(distance, row of ``one``, row of ``two``) of the pairs that pass."""
        for w, part in two.groupby(two["sketch"].map(len)):
            wide = np.frombuffer(b"".join(part["sketch"]), dtype=np.uint64).reshape(len(part), -1)
            nb, cb, kb, at = part["size"].to_numpy(), part["component"].to_numpy(), part["node"].to_numpy(), part["at"].to_numpy()
            folded = {least: _fold(wide, least) for least in {min(w, len(s)) // 8 for s in one["sketch"]}}
            for row in one.itertuples():
                n = row.size
                least = min(w, len(row.sketch)) // 8
                own = _fold(np.frombuffer(row.sketch, dtype=np.uint64)[None, :], least)
                far = np.bitwise_count(folded[least] ^ own).sum(axis=1).astype(np.int64)
                fit = (far * (100 + percent) <= (nb + n) * (100 - percent)) & (cb != row.component) & (100 * np.minimum(nb, n) >= percent * np.maximum(nb, n)) & (kb != row.node)
                yield from zip(far[fit].tolist(), [row.at] * int(fit.sum()), at[fit].tolist())

    def connecting(pairs, of):
        """The nearest of ``pairs`` that connect components: a spanning forest, which a later one of more pairs can start from."""
        root, kept = {}, []

        def find(c):
            while root.setdefault(c, c) != c:
                root[c] = c = root[root[c]]
            return c

        for pair in sorted(pairs):
            x, y = find(of[pair[1]]), find(of[pair[2]])
            if x != y:
                root[x] = y
                kept.append(pair)
        return kept

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(at=np.arange(len(pdf)))
        one, two = pdf[pdf["piece"] == pdf["p"]], pdf[pdf["piece"] == pdf["q"]]
        kept: list[tuple] = []
        node, of = pdf["node"].tolist(), pdf["component"].tolist()
        keys = None if forest else [frozenset(k) for k in pdf["keys"]]
        # pieces meet by squares, so that few pairs are held at once
        for i in range(0, len(one), SQUARE):
            for j in range(i if len(one) and pdf["p"].iloc[0] == pdf["q"].iloc[0] else 0, len(two), SQUARE):
                pairs = {(far, *sorted(ends)) for far, *ends in fits(one[i : i + SQUARE], two[j : j + SQUARE])}
                if forest:
                    kept = connecting(pairs.union(kept), of)
                else:
                    kept += [x for x in pairs if min(keys[x[1]] & keys[x[2]]) == pdf["key"].iloc[0]]
        found = [(min(node[i], node[j]), max(node[i], node[j])) for _, i, j in kept]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, common_in: int = 16, most_common: int = 1 << 20, small: int = 64, piece: int = 4096, forests: int = 1, broadcast_rows: int = 200_000) -> DataFrame:
    """(id, n_shingles, component_id) per row.

    A set holds the distinct ``words``-word shingles of the text in lower case (A-Z); a text
    with fewer words is one shingle, one without words (or null) has an empty set and is its
    own component. Sets link when 100 * intersection >= percent * union. ``component_id`` is
    the smallest id reachable by links; rows with equal sets are linked; a null id never
    names a component unless no other does. Pairs whose ends
    other links connect already aren't verified one by one, so links are not counted. Shingles
    are told apart by 56-bit hashes within pairs that meet. An empty table gives an empty result.

    ``common_in``: a block that so many distinct sets of one batch have counts as common and
    is used last; at most ``most_common`` are known to all tasks (8 MB), any choice of them
    gives the same links. Texts to verify are fetched by a broadcast of their ids if those
    are counted and no more than ``broadcast_rows``, else by a shuffled join.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    both = materialize(rows.mapInArrow(_sets(words, percent, common_in), "id long, node long, size long, sketch binary, key long, hits long"), "parity-sets")
    sets = both.filter("key is null").drop("key", "hits")
    top = both.filter("key is not null").groupBy("key").agg(F.sum("hits").alias("hits")).orderBy(F.desc("hits"), "key").limit(most_common).select("key")
    common = np.sort(top.toPandas()["key"].to_numpy(dtype=np.int64)).astype(np.uint64)
    nodes = materialize(sets.filter("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.max("size").alias("size"), F.first("sketch").alias("sketch")), "parity-nodes")

    entries = rows.mapInArrow(_entries(words, percent, common), "key long, node long, size long")
    in_block = Window.partitionBy("key").orderBy("size", "node")
    met = (
        entries.withColumn("before", F.lag("node").over(in_block))
        .withColumn("after", F.lead("node").over(in_block))
        .withColumn("head", F.first("node").over(in_block))
        .withColumn("before_size", F.lag("size").over(in_block))
        .withColumn("head_size", F.first("size").over(in_block))
        .filter("(before is not null and before <> node) or (after is not null and after <> node)")
        .filter("before is null or before <> node")
        .select("key", "node", "size", "head", "before", "head_size", "before_size")
    )
    met = materialize(met, "parity-met")
    partner = F.explode(F.array(F.struct(F.col("head").alias("node"), F.col("head_size").alias("size")), F.struct(F.col("before").alias("node"), F.col("before_size").alias("size"))))
    near = (F.col("x.node") != F.col("node")) & (100 * F.least("x.size", "size") >= percent * F.greatest("x.size", "size"))
    first_pairs = met.filter("before is not null").select(partner.alias("x"), "node", "size").filter(near).select(F.least("x.node", "node").alias("a"), F.greatest("x.node", "node").alias("b")).distinct()
    first_pairs = materialize(first_pairs, "parity-pairs")

    def verify(pairs: DataFrame, label: DataFrame | None, nearest_first: int) -> DataFrame:
        """Labels (node, component) after those of ``pairs`` (a, b) that are needed to connect what links connect.

        Sketches thin the pairs out. Before all that are left are verified, each of
        ``nearest_first`` rounds takes the nearest pair of every node whose ends aren't
        connected yet, so that few pairs fetch the sets themselves and no connection is lost.
        """
        one = nodes.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("sketch").alias("sketch_a"))
        two = nodes.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("sketch").alias("sketch_b"))
        fit = materialize(pairs.join(one, "a").join(two, "b").mapInArrow(_near(percent), "a long, b long, size_a long, size_b long, far long"), "parity-fit")
        wanted = fit.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "id"), "node")
        wanted = materialize(wanted.withColumnRenamed("id", "wanted_id"), "parity-wanted")
        if wanted.count() <= broadcast_rows:
            wanted = F.broadcast(wanted)
        texts = rows.join(wanted, F.col("id").eqNullSafe(F.col("wanted_id"))).select("text")
        found = materialize(texts.mapInArrow(_hash_lists(words), "node long, hashes array<long>").dropDuplicates(["node"]), "parity-lists")
        for last in (*[False] * nearest_first, True):
            if label is not None:
                own = lambda end: label.select(F.col("node").alias(end), F.col("component").alias(f"{end}_of"))  # noqa: B023, E731
                fit = fit.join(own("a"), "a", "left").join(own("b"), "b", "left").filter(F.coalesce("a_of", "a") != F.coalesce("b_of", "b")).drop("a_of", "b_of")
                fit = materialize(fit, "parity-fit")
            tried = fit
            if not last:
                nearest = fit.select(F.explode(F.array("a", "b")).alias("node"), F.struct("far", "a", "b", "size_a", "size_b").alias("pair")).groupBy("node").agg(F.min("pair").alias("pair"))
                tried = materialize(nearest.select("pair.*").distinct(), "parity-tried")
            pair = tried.join(found.select(F.col("node").alias("a"), F.col("hashes").alias("hashes_a")), "a").join(found.select(F.col("node").alias("b"), F.col("hashes").alias("hashes_b")), "b")
            shared = F.size(F.array_intersect("hashes_a", "hashes_b"))
            linked = materialize(pair.filter(100 * shared >= percent * (F.col("size_a") + F.col("size_b") - shared)).select("a", "b"), "parity-links")
            if not last:
                fit = fit.join(tried.select("a", "b"), ["a", "b"], "left_anti")
            edges = linked if label is None else linked.unionByName(label.select(F.col("node").alias("a"), F.col("component").alias("b")))
            label = materialize(components(edges), "parity-labels")
        return label

    label = verify(first_pairs, None, 1)
    tried = first_pairs

    def still_open() -> DataFrame:
        """Rows of the blocks whose nodes lie in different components."""
        labelled = met.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("head", "before", "head_size", "before_size")
        spread = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi and members > 2").select("key", "members")
        return materialize(labelled.join(spread, "key"), "parity-open")

    def in_pieces(many: DataFrame, forest: bool) -> DataFrame:
        """Pairs of the large blocks, compared piece by piece."""
        count = F.count(F.lit(1)).over(Window.partitionBy("key"))
        many = many.withColumn("members", count).withColumn("piece", F.floor((F.row_number().over(Window.partitionBy("key").orderBy("node")) - 1) / piece).cast("int"))
        many = many.withColumn("pieces", F.ceil(F.col("members") / piece).cast("int")).join(nodes.select("node", "sketch"), "node")
        each = many.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("p", F.least("piece", "o")).withColumn("q", F.greatest("piece", "o"))
        return each.select("key", "p", "q", "piece", "node", "size", "component", "sketch", "keys").groupBy("key", "p", "q").applyInPandas(_piecewise(percent, forest), "a long, b long")

    open_ = still_open()
    few = open_.filter(F.col("members") <= small)
    other = few.select("key", F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("component").alias("component_b"))
    fits = (F.col("node") < F.col("b")) & (F.col("component") != F.col("component_b")) & (100 * F.least("size", "size_b") >= percent * F.greatest("size", "size_b"))
    mine = few.withColumnRenamed("key", "own_key")
    pairs = mine.join(other, (F.col("own_key") == F.col("key")) & fits).select(F.col("node").alias("a"), "b")
    for forest in (*range(forests), None):
        many = open_.filter(F.col("members") > small).select("key", "node", "size", "component")
        if forest is None:
            own = many.groupBy("node").agg(F.collect_list("key").alias("keys"))
            more = in_pieces(many.join(own, "node"), False)
        else:  # every node in one of its blocks
            turn = F.xxhash64("key", F.lit(forest))
            more = in_pieces(many.withColumn("first", F.min(turn).over(Window.partitionBy("node"))).filter(F.col("first") == turn).select("key", "node", "size", "component", F.lit(None).cast("array<bigint>").alias("keys")), True)
        pairs = more if pairs is None else pairs.unionByName(more)
        pairs = materialize(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "parity-pairs")
        if not pairs.isEmpty():
            tried = tried.unionByName(pairs)
            label = verify(pairs, label, 0)
        if forest is not None:
            open_ = still_open()
        pairs = None

    named = nodes.select("node", F.col("id").alias("least_id")).join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_node = named.select("node", "component").join(names, "component").select("node", "component_id")
    in_sets = sets.filter("node is not null").join(of_node, "node").select("id", "size", "component_id")
    empty = sets.filter("node is null").select("id", "size", F.col("id").alias("component_id"))
    return in_sets.unionByName(empty).select("id", F.col("size").alias("n_shingles"), "component_id")


def _near(percent: int):
    """Pairs whose sketches don't rule out a link."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            if batch.num_rows:
                total = c["size_a"].to_numpy() + c["size_b"].to_numpy()
                far = _distances(c["sketch_a"].to_pylist(), c["sketch_b"].to_pylist())
                near = pa.array(far * (100 + percent) <= total * (100 - percent))
                yield pa.RecordBatch.from_arrays([*[c[k].filter(near) for k in ("a", "b", "size_a", "size_b")], pa.array(far).filter(near)], ["a", "b", "size_a", "size_b", "far"])

    return run
