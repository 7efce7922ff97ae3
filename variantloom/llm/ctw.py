"""LM scoring by context-tree weighting over bytes.

Each byte is eight binary decisions. A decision's node is the bits of its byte so far, seen in
the context of the last d bytes, for every d from 0 to the depth. Nodes hold counts of zeros
and ones and estimate by Krichevsky-Trofimov; a context's weighted probability is half its own
estimate and half the product of its longer contexts' weighted probabilities. Trained on the
whole training corpus, the tree predicts a byte by mixing the estimates of all depths at which
its context has been met, each with its posterior weight. The sum over a text is its code length.

How it is spread: texts are dealt into blocks of bounded size. Each block counts its own
distinct (context, byte) strings and words; the counts are summed over blocks, the tree is
built in ranges of recent context (each at most 2^24 strings, whatever the corpus), every
distinct string gets its log probability once, and each block gets back only its own strings.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textbytes import bytes_of, chunks, word_hashes

LOG2 = float(np.log(2.0))


def _grams(x: np.ndarray, begin: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(strings, text of each): the latest context byte first, the predicted byte last."""
    n = len(x) - depth
    key = np.zeros(n, dtype=np.uint64)
    for back in range(1, depth + 1):
        key = (key << np.uint64(8)) | x[depth - back : depth - back + n]
    key = (key << np.uint64(8)) | x[depth:]
    size = np.diff(begin) - depth  # predicted bytes of each text
    at = np.repeat(begin[:-1] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return key[at], np.repeat(np.arange(len(size)), size)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[edge], np.add.reduceat(c, edge) if len(edge) else c


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[edge], np.diff(np.append(edge, len(x)))


def _count(depth: int):
    """Of a block: each distinct string and word, and how often the training texts have it."""
    import pyarrow as pa

    def run(table):
        block = table.column("block")[0].as_py()
        train = np.asarray(table.column("train").to_numpy(), dtype=np.uint64)
        data, offsets = bytes_of(table.column("text"))
        out = []
        for word in (False, True):
            keys, counts = [], []
            for a, x, begin in chunks(data, offsets, depth, 1 << 16):
                key, text = word_hashes(x, begin) if word else _grams(x, begin, depth)
                k, c = _runs((key << np.uint64(1)) | train[a + text])
                keys.append(k)
                counts.append(c)
                if len(keys) == 8:
                    k, c = _merge(keys, counts)
                    keys, counts = [k], [c]
            if keys:
                k, c = _merge(keys, counts)
                k, c = _merge([k >> np.uint64(1)], [np.where(k & np.uint64(1), c, 0)])
                out.append(pa.table({"block": pa.array(np.full(len(k), block, np.int64)), "word": pa.array(np.full(len(k), word)), "key": pa.array(k.astype(np.int64)), "n": pa.array(c.astype(np.int64))}))
        return pa.concat_tables(out)

    return run


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 1/2: Stirling's series after eight steps up."""
    y = x.astype(np.float64)
    product = np.ones_like(y)
    for i in range(8):
        product *= y + i
    shift = np.log(product)
    y = y + 8
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - shift


def _kt(ones: np.ndarray, total: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability of ``ones`` among ``total``."""
    return _lgamma(ones + 0.5) + _lgamma(total - ones + 0.5) - _lgamma(total + 1.0) - np.log(np.pi)


class _Level:
    """The nodes of one context length: by bit i, sorted ids (context << i | first i bits), totals, ones, own weight."""

    def __init__(self, code: np.ndarray, n: np.ndarray, child: list | None):
        """code: sorted context << 8 | byte. child: for each bit, (parent ids, log weighted probabilities) of the longer contexts."""
        self.ids, self.total, self.ones, self.own, self.log = [], [], [], [], []
        n = n.astype(np.float64)
        for i in range(8):
            node = code >> np.uint64(8 - i)
            edge = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
            total = np.add.reduceat(n, edge) if len(edge) else n
            ones = np.add.reduceat(n * ((code >> np.uint64(7 - i)) & np.uint64(1)), edge) if len(edge) else n
            ids = node[edge]
            log = _kt(ones, total)
            own = np.ones(len(ids))
            if child is not None:
                parents, logs = child[i]
                below = np.bincount(np.searchsorted(ids, parents), logs, minlength=len(ids))
                own = 1 / (1 + np.exp(np.clip(below - log, -700, 700)))
                log = np.logaddexp(log, below) - LOG2
            self.ids.append(ids)
            self.total.append(total)
            self.ones.append(ones)
            self.own.append(own)
            self.log.append(np.where(total > 0, log, 0.0))

    def parents(self) -> list:
        """For each bit: the next shorter context's node ids and these nodes' log weighted probabilities."""
        out = []
        for i in range(8):
            low = self.ids[i] & np.uint64((1 << i) - 1)
            out.append((((self.ids[i] >> np.uint64(8 + i)) << np.uint64(i)) | low, self.log[i]))
        return out

    def mix(self, context: np.ndarray, byte: np.ndarray, p: list[np.ndarray]) -> None:
        """Mix this level's estimate of each bit of ``byte`` into ``p`` (NaN: no longer context met)."""
        code = (context << np.uint64(8)) | byte
        for i in range(8):
            at = np.searchsorted(self.ids[i], code >> np.uint64(8 - i))
            at = np.minimum(at, max(0, len(self.ids[i]) - 1))
            if not len(self.ids[i]):
                continue
            met = (self.ids[i][at] == code >> np.uint64(8 - i)) & (self.total[i][at] > 0)
            one = (code >> np.uint64(7 - i)) & np.uint64(1) == 1
            hits = np.where(one, self.ones[i][at], self.total[i][at] - self.ones[i][at])
            kt = (hits + 0.5) / (self.total[i][at] + 1.0)
            own = np.where(np.isnan(p[i]), 1.0, self.own[i][at])
            p[i][met] = (own * kt + (1 - own) * np.nan_to_num(p[i]))[met]


def _levels(key: np.ndarray, n: np.ndarray, depth: int, least: int) -> list[_Level]:
    """Levels ``depth`` down to ``least`` of sorted distinct strings that hold whole contexts of length ``least``."""
    out, child = [], None
    for d in range(depth, least - 1, -1):
        code = ((key >> np.uint64(8 * (depth - d + 1))) << np.uint64(8)) | (key & np.uint64(255))
        if d < depth:
            code, inverse = np.unique(code, return_inverse=True)
            count = np.bincount(inverse, n, minlength=len(code))
        else:
            count = n
        out.append(_Level(code, count, child))
        child = out[-1].parents()
    return out


def _whole(batches, depth: int, least: int, rows: int = 400_000):
    """(keys, counts) gathered from sorted batches so that no context of length ``least`` is cut."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    shift = np.uint64(8 * (depth - least + 1))
    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy().astype(np.uint64)])
        counts = np.concatenate([counts, batch.column(1).to_numpy()])
        if len(keys) >= rows:
            cut = int(np.searchsorted(keys >> shift, keys[-1] >> shift))
            if cut:
                yield keys[:cut], counts[:cut]
                keys, counts = keys[cut:], counts[cut:]
    if len(keys):
        yield keys, counts


def _upper(code: np.ndarray, n: np.ndarray, child: list, top: int) -> list[_Level]:
    """Levels ``top`` down to 0 from that level's (context << 8 | byte) counts and the sums below."""
    out = []
    for d in range(top, -1, -1):
        out.append(_Level(code, n, child))
        child = out[-1].parents()
        code, inverse = np.unique(((code >> np.uint64(16)) << np.uint64(8)) | (code & np.uint64(255)), return_inverse=True)
        n = np.bincount(inverse, n, minlength=len(code))
    return out


def _sums(depth: int, least: int):
    """What the upper levels need: counts by the next shorter context (bit -1), and log sums by its nodes."""
    import pyarrow as pa

    def run(batches):
        for key, n in _whole(batches, depth, least):
            lowest = _levels(key, n, depth, least)[-1]
            code = ((key >> np.uint64(8 * (depth - least + 2))) << np.uint64(8)) | (key & np.uint64(255))
            code, inverse = np.unique(code, return_inverse=True)
            parts = [(np.full(len(code), -1), code, np.bincount(inverse, n, minlength=len(code)))]
            for i, (ids, log) in enumerate(lowest.parents()):
                ids, inverse = np.unique(ids, return_inverse=True)
                parts.append((np.full(len(ids), i), ids, np.bincount(inverse, log, minlength=len(ids))))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[j] for p in parts]), t) for j, t in enumerate((pa.int32(), pa.int64(), pa.float64()))], ["bit", "node", "value"])

    return run


def _strings(depth: int, least: int, upper: list[_Level]):
    """log10 probability of every distinct string's byte in its context."""
    import pyarrow as pa

    def run(batches):
        for key, n in _whole(batches, depth, least):
            byte = key & np.uint64(255)
            p = [np.full(len(key), np.nan) for _ in range(8)]
            for j, level in enumerate(_levels(key, n, depth, least) + upper):
                level.mix(key >> np.uint64(8 * (j + 1)), byte, p)
            score = sum(np.log10(np.where(np.isnan(x), 0.5, x)) for x in p)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(score)], ["key", "value"])

    return run


def _score(depth: int, tokens: int, kinds: int, ends: int):
    """Per text of a block: n_tokens, n_known, base_score, score."""
    import pyarrow as pa

    room = 64 - 8 * (depth + 1)
    base = tokens + 0.5 * (kinds + 1)

    def table_of(values, word):
        at = np.flatnonzero(values.column("word").to_numpy() == word)
        key = values.column("key").to_numpy()[at].astype(np.uint64)
        order = np.argsort(key)
        return key[order], values.column("value").to_numpy()[at][order]

    def run(texts, values):
        n = texts.num_rows
        score, base_score = np.zeros(n), np.zeros(n)
        n_tokens, n_known = np.ones(n, np.int64), np.full(n, int(ends > 0), np.int64)
        if n:
            gram_keys, gram_log = table_of(values, False)
            word_keys, word_count = table_of(values, True)
            data, offsets = bytes_of(texts.column("text"))
            for a, x, begin in chunks(data, offsets, depth, 1 << min(room, 16)):
                m = len(begin) - 1
                key, text = _grams(x, begin, depth)
                packed = np.sort((key << np.uint64(room)) | text.astype(np.uint64))
                text = (packed & np.uint64((1 << room) - 1)).astype(np.int64)
                packed >>= np.uint64(room)
                edge = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
                each = gram_log[np.searchsorted(gram_keys, packed[edge])]
                score[a : a + m] = np.bincount(text, np.repeat(each, np.diff(np.append(edge, len(packed)))), minlength=m)
                key, text = word_hashes(x, begin)
                if len(key):
                    uniq, inverse = np.unique(key, return_inverse=True)
                    c = word_count[np.searchsorted(word_keys, uniq)][inverse]
                    n_tokens[a : a + m] += np.bincount(text, minlength=m)
                    n_known[a : a + m] += np.bincount(text, c > 0, minlength=m).astype(np.int64)
                    base_score[a : a + m] = np.bincount(text, np.log10((c + 0.5) / base), minlength=m)
            base_score += np.log10((ends + 0.5) / base)
        return pa.table({"id": texts.column("id"), "train": texts.column("train"), "n_tokens": pa.array(n_tokens), "n_known": pa.array(n_known), "base_score": pa.array(base_score, pa.float64()), "score": pa.array(score, pa.float64())})

    return run


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = 5, block_bytes: int = 24 << 20) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) per row.

    ``train`` says which rows are learned from (null: not); all rows are scored. A null text
    is empty: only its end is scored. Texts are taken in lower case (A-Z only); ``score`` is
    the tree's log10 probability of all bytes and the end, ``base_score`` that of the words
    and the end by a smoothed unigram model. Words are told apart by 63-bit hashes. Without
    training rows every bit has probability 1/2. Repeated rows count as often as they occur;
    an empty table gives an empty result. ``depth`` context bytes, 2 to 5.
    """
    spark = docs.sparkSession
    least = depth - 2
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    facts = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.col("train").cast("long")), F.lit(0)).alias("ends")).first()
    blocks = max(1, -(-facts["bytes"] // block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    counts = materialize(dealt.groupBy("block").applyInArrow(_count(depth), "block long, word boolean, key long, n long"), "ctw-counts")
    totals = materialize(counts.groupBy("word", "key").agg(F.sum("n").alias("n")), "ctw-totals")
    words = totals.filter("word")
    known = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    tokens, kinds = known["n"] + facts["ends"], known["v"] + (facts["ends"] > 0)
    recent = F.shiftright("key", 8 * (depth - least + 1))
    strings = totals.filter("not word").select("key", "n").repartition(recent).sortWithinPartitions("key")
    above = strings.mapInArrow(_sums(depth, least), "bit int, node long, value double").groupBy("bit", "node").agg(F.sum("value").alias("value")).toPandas()
    above = above.sort_values(["bit", "node"])
    part = lambda i: (above.loc[above["bit"] == i, "node"].to_numpy().astype(np.uint64), above.loc[above["bit"] == i, "value"].to_numpy())
    upper = _upper(*part(-1), [part(i) for i in range(8)], least - 1) if least > 0 else []
    logs = strings.mapInArrow(_strings(depth, least, upper), "key long, value double").select(F.lit(False).alias("word"), "key", "value")
    values = logs.unionByName(words.select("word", "key", F.col("n").cast("double").alias("value")))
    back = counts.select("block", "word", "key").join(values, ["word", "key"]).select("block", "word", "key", "value")
    schema = "id long, train boolean, n_tokens long, n_known long, base_score double, score double"
    scored = dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_score(depth, tokens, kinds, facts["ends"]), schema)
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))
