"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of itself and its character n-grams; each hashes to an embedding. A passage
of a few words is the mean of all its subwords' embeddings, read by a two-class softmax.
Embeddings and softmax are trained together in numpy. Labels belong to documents: a toxic
document needs one toxic passage, so after the first rounds a document is trained on the
passages that the model finds worst, and a document's score is its worst passage's.

The softmax is linear and the mean is a sum over a count, so at scoring every subword shrinks
to one number and a word to a (sum, count) pair.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE = 6
BUCKETS = 1 << 17
KNOWN_WORDS = 400_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def subwords(word: str, low: int = 3, high: int = 5) -> list[int]:
    """Buckets of the whole word and of its n-grams with both ends marked; empty for a word without letter or digit."""
    w = _EDGES.sub("", word.lower())
    if not w:
        return []
    w = f"<{w}>"
    grams = {w} | {w[i : i + n] for n in range(low, high + 1) for i in range(len(w) - n + 1)}
    return sorted({zlib.crc32(g.encode()) & (BUCKETS - 1) for g in grams})


def _segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _flat(offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the members of segments ``at``, and how many each has."""
    size = offsets[at + 1] - offsets[at]
    return np.repeat(offsets[at] - (np.cumsum(size) - size), size) + np.arange(size.sum()), size


class SubwordBag:
    def __init__(self, dim: int = 8, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.1, (BUCKETS, dim))
        self.w = rng.normal(0, 0.5, dim)
        self.b = 0.0

    def weights(self) -> np.ndarray:
        return (self.emb @ self.w).astype(np.float32)

    def fit(self, docs: list[tuple[str, int]], epochs: int = 10, batch: int = 256, rate: float = 0.5, seed: int = 13) -> None:
        """docs: (text, 0 or 1)."""
        rng = np.random.default_rng(seed)
        number: dict[str, int] = {}
        lists: list[list[int]] = []
        words, owner, label = [], [], []
        for text, y in docs:
            ids = []
            for raw in _WORD.findall(text):
                if raw not in number:
                    number[raw] = len(lists)
                    lists.append(subwords(raw))
                ids.append(number[raw])
            for a in range(0, len(ids), PASSAGE):
                words.append(ids[a : a + PASSAGE])
                owner.append(len(label))
            label.append(y)
        label_, owner_ = np.array(label), np.array(owner, dtype=np.int64)
        if not len(owner_) or label_.min() == label_.max():
            return
        sub = np.array([s for x in lists for s in x], dtype=np.int64)
        sub_at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        word = np.array([w for p in words for w in p], dtype=np.int64)
        word_at = np.concatenate([[0], np.cumsum([len(p) for p in words])])
        y_of = label_[owner_]
        counts = np.diff(sub_at)
        g_emb, g_w, g_b = np.full(self.emb.shape[0], 1e-8), np.full(len(self.w), 1e-8), 1e-8
        for epoch in range(epochs):
            if epoch < 2:
                per = 15_000
                chosen = np.concatenate([rng.permutation(np.flatnonzero(y_of == c))[:per] for c in (0, 1)])
            else:
                s = self.weights()
                z = _segment_sums(_segment_sums(s[sub], sub_at)[word], word_at) / np.maximum(1, _segment_sums(counts[word], word_at))
                order = np.lexsort((-z, owner_))
                nth = np.arange(len(order)) - np.concatenate([[0], np.cumsum(np.bincount(owner_, minlength=len(label_)))])[owner_[order]]
                chosen = order[(nth == 0) | ((nth < 4) & (y_of[order] == 0))]
            chosen = rng.permutation(chosen)
            for a in range(0, len(chosen), batch):
                p = chosen[a : a + batch]
                at, n_words = _flat(word_at, p)
                w_ids = word[at]
                at, n_sub = _flat(sub_at, w_ids)
                ids = sub[at]
                size = np.maximum(1, _segment_sums(n_sub, np.concatenate([[0], np.cumsum(n_words)]))).astype(np.int64)
                of = np.repeat(np.repeat(np.arange(len(p)), n_words), n_sub)
                share = 1.0 / size[of]
                mean = np.stack([np.bincount(of, self.emb[ids, d] * share, minlength=len(p)) for d in range(len(self.w))], axis=1)
                z = mean @ self.w + self.b
                g = (1 / (1 + np.exp(-z)) - y_of[p]) / 16
                d_w, d_b = mean.T @ g, g.sum()
                uniq, inv = np.unique(ids, return_inverse=True)
                pull = np.bincount(inv, g[of] * share * 16, minlength=len(uniq))
                g_emb[uniq] += pull**2
                g_w += d_w**2
                g_b += d_b**2
                self.emb[uniq] -= (rate * pull / np.sqrt(g_emb[uniq]))[:, None] * self.w[None]
                self.w -= 0.1 * d_w / np.sqrt(g_w)
                self.b -= 0.1 * d_b / np.sqrt(g_b)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 2000, longest: int = 20_000) -> SubwordBag:
    """A model from at most about ``per_class`` labelled documents of each class with up to ``longest`` characters.

    An id labelled more than once counts as toxic if any label says so; of ids that repeat so
    often that more than four times ``per_class`` rows are drawn, that many are used. Documents are drawn by
    a hash of their id; the ids drawn, no more than about twice ``per_class``, are broadcast so
    that texts are not shuffled. With no rows of one class the untrained model is returned.
    """
    y = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    counts = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}
    unit = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    chance = F.when(F.col("y") == 1, min(1.0, per_class / counts.get(1, 1))).otherwise(min(1.0, per_class / counts.get(0, 1)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull() & (F.length("text") <= longest))
    picked = rows.join(F.broadcast(y.filter(unit < chance)), "id").select("id", "text", "y").limit(4 * per_class).collect()
    model = SubwordBag()
    model.fit([(r["text"], r["y"]) for r in sorted(picked, key=lambda r: (r["id"], r["text"]))])
    return model


class _Met:
    """Words met by this Python worker: their number, and by number their sum and count of subwords."""

    def __init__(self, model: int):
        self.model, self.at = model, {}
        self.sum, self.count = np.zeros(KNOWN_WORDS), np.zeros(KNOWN_WORDS)

    def numbers(self, words: list[str], s: np.ndarray) -> np.ndarray:
        at = self.at
        new = [w for w in words if w not in at]
        if len(at) + len(new) > len(self.sum):
            at.clear()
            new = words
            if len(new) > len(self.sum):
                self.sum, self.count = np.zeros(len(new)), np.zeros(len(new))
        if new:
            lists = [subwords(w) for w in new]
            size = np.array([len(x) for x in lists], dtype=np.int64)
            n = len(at)
            flat = s[np.array([i for x in lists for i in x], dtype=np.int64)]
            self.sum[n : n + len(new)] = _segment_sums(flat, np.concatenate([[0], np.cumsum(size)]))
            self.count[n : n + len(new)] = size
            at.update(zip(new, range(n, n + len(new))))
        return np.array([at[w] for w in words], dtype=np.int64)


_met = _Met(0)


def _scorer(s: np.ndarray, b: float):
    import pyarrow as pa
    import pyarrow.compute as pc

    from .words import batch_words

    mark = zlib.crc32(s.tobytes())

    def score(batches):
        global _met
        if _met.model != mark:
            _met = _Met(mark)
        for batch in batches:
            texts = batch.column(1)
            n = len(texts)
            step = 4000
            best = np.full(n, -np.inf)
            for a in range(0, n, step):
                numbers, offsets, words = batch_words(pc.utf8_lower(texts.slice(a, step)))
                numbers = _met.numbers(words, s)[numbers]
                length = np.diff(offsets)
                pieces = -(-length // PASSAGE)
                doc = np.repeat(np.arange(len(length)), pieces)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                edges = np.append(offsets[:-1][doc] + nth * PASSAGE, offsets[-1]).astype(np.int64)
                if len(doc):
                    total = np.add.reduceat(_met.sum[numbers], edges[:-1])
                    count = np.add.reduceat(_met.count[numbers], edges[:-1])
                    np.maximum.at(best, a + doc, total / np.maximum(1, count))
            p = 1 / (1 + np.exp(-np.clip(np.where(np.isfinite(best), best, 0.0) + b, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())], ["id", "score", "predicted"])

    return score


def score_toxicity(docs: DataFrame, model: SubwordBag, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) per row; a null or empty text scores as a passage without subwords.

    Whole texts are read; repeated rows and null ids are scored like any other; an empty
    table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_scorer(model.weights(), float(model.b)), "id long, score double, predicted int")
