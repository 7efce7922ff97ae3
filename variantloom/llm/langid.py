"""Language ID by a byte convolutional network.

Bytes are embedded, filters of several widths run over fixed-length windows of the text, each
filter keeps its largest response in the window, and a softmax layer reads those. The network
is trained in numpy on a bounded sample of labelled text; every window of every text is
scored, and a document gets the mean of its windows' probabilities, weighted by their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 256
UNKNOWN = "und"


class ByteCNN:
    """Embedding (256, dim), one filter bank padded to the widest width, output layer."""

    def __init__(self, classes: list[str], dim: int = 6, widths=(2, 3, 4), filters: int = 12, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.classes, self.dim, self.widest = classes, dim, max(widths)
        total = filters * len(widths)
        mask = np.zeros((self.widest * dim, total), dtype=np.float32)
        for i, w in enumerate(widths):
            mask[: w * dim, i * filters : (i + 1) * filters] = 1
        self.mask = mask
        self.p = {
            "emb": rng.normal(0, 0.5, (256, dim)),
            "conv": rng.normal(0, 1, mask.shape) * mask / np.sqrt(mask.sum(axis=0)),
            "bias": np.zeros(total),
            "out": rng.normal(0, 0.1, (total, len(classes))),
            "base": np.zeros(len(classes)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _patches(self, x: np.ndarray) -> np.ndarray:
        """(windows, WINDOW, widest * dim) from bytes (windows, WINDOW)."""
        padded = np.zeros((len(x), x.shape[1] + self.widest - 1), dtype=x.dtype)
        padded[:, : x.shape[1]] = x
        e = self.p["emb"][padded]
        return np.concatenate([e[:, i : i + x.shape[1]] for i in range(self.widest)], axis=2)

    def _pooled(self, x: np.ndarray) -> np.ndarray:
        patches = self._patches(x)
        return (patches.reshape(-1, patches.shape[2]) @ self.p["conv"]).reshape(*x.shape, -1).max(axis=1)

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.p["bias"], 0) @ self.p["out"] + self.p["base"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, x: np.ndarray, block: int = 32) -> np.ndarray:
        return np.concatenate([self._softmax(self._pooled(x[i : i + block])) for i in range(0, len(x), block)]) if len(x) else np.zeros((0, len(self.classes)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.004, seed: int = 5, least_steps: int = 600) -> None:
        """Adam over shuffled batches: ``epochs`` passes, or as many as make ``least_steps`` steps where windows are few."""
        epochs = max(epochs, -(-least_steps // max(1, -(-len(x) // batch))))
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                at = order[a : a + batch]
                xb = x[at].copy()
                for row in np.flatnonzero(rng.random(len(at)) < 0.4):  # short texts too
                    xb[row, rng.integers(10, WINDOW) :] = 0
                patches = self._patches(xb)
                conv = (patches.reshape(-1, patches.shape[2]) @ self.p["conv"]).reshape(*xb.shape, -1)
                where = conv.argmax(axis=1)
                pooled = np.take_along_axis(conv, where[:, None], axis=1)[:, 0]
                act = np.maximum(pooled + self.p["bias"], 0)
                d = self._softmax(pooled)
                d[np.arange(len(at)), y[at]] -= 1
                d /= len(at)
                back = (d @ self.p["out"].T) * (act > 0)
                picked = np.take_along_axis(patches[:, :, None, :], where[:, None, :, None], axis=1)[:, 0]  # (rows, filters, widest * dim)
                g = {"out": act.T @ d, "base": d.sum(axis=0), "bias": back.sum(axis=0), "conv": np.einsum("rfk,rf->kf", picked, back) * self.mask}
                g_emb = np.zeros_like(self.p["emb"])
                spread = (back[:, :, None] * self.p["conv"].T[None]).reshape(len(at), -1, self.widest, self.dim)
                for i in range(self.widest):
                    pos = where + i
                    byte = np.where(pos < WINDOW, np.take_along_axis(xb, np.minimum(pos, WINDOW - 1), axis=1), 0)
                    np.add.at(g_emb, byte.ravel(), spread[:, :, i].reshape(-1, self.dim))
                g["emb"] = g_emb
                step += 1
                lr = rate * (1 - 0.8 * epoch / max(1, epochs))
                for k in self.p:
                    m[k] += 0.1 * (g[k] - m[k])
                    v2[k] += 0.01 * (g[k] ** 2 - v2[k])
                    self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-6)


def windows_of(texts: list[bytes]) -> np.ndarray:
    """One window per text: its first WINDOW bytes, zeros behind."""
    out = np.zeros((len(texts), WINDOW), dtype=np.uint8)
    for i, t in enumerate(texts):
        b = np.frombuffer(t[:WINDOW], dtype=np.uint8)
        out[i, : len(b)] = b
    return out


def fit_language_model(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_windows: int = 12_000, per_doc: int = 3) -> ByteCNN | None:
    """A network trained on at most about ``max_windows`` windows of labelled text, shared evenly by the languages.

    Documents are chosen by a hash of their id and text, windows by a hash of the id, so
    reruns agree; of rows that repeat so often that more than twice ``max_windows`` are drawn,
    that many are used.
    Rows without text or language are passed over; None if nothing can be learned.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = max(1, max_windows // per_doc // len(counts))
    chance = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, share / n)))])[F.col("lang")]
    unit = F.pmod(F.xxhash64("id", "text", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    start = [1 + F.pmod(F.xxhash64("id", F.lit(j)), F.greatest(F.length("text") - WINDOW // 2, F.lit(1))) for j in range(per_doc)]
    picked = rows.filter(unit < chance).select("lang", F.array(*[F.substring(F.col("text"), s.cast("int"), F.lit(WINDOW)) for s in start]).alias("parts")).limit(2 * max_windows).collect()
    classes = sorted(counts)
    number = {k: i for i, k in enumerate(classes)}
    model = ByteCNN(classes)
    pieces = [(number[r["lang"]], p.encode()) for r in picked for p in dict.fromkeys(r["parts"]) if p.strip()]
    if len(classes) > 1 and pieces:
        model.fit(windows_of([p for _, p in pieces]), np.array([c for c, _ in pieces]))
    return model


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _predictor(model: ByteCNN | None):
    """A column of (lang_pred, score) structs from a text column and whether the text has a letter; only these two reach Python."""

    def score(texts: pa.Array, letters: pa.Array) -> pa.Array:
        texts = pc.cast(texts, pa.large_string())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if n and texts.buffers()[2] else np.zeros(0, np.uint8)
        lang, best = np.array([UNKNOWN] * n, dtype=object), np.zeros(n)
        if model and n:
            size = np.where(letters.to_numpy(zero_copy_only=False), np.diff(offsets), 0)
            pieces = -(-size // WINDOW)
            doc = np.repeat(np.arange(n), pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = offsets[:-1][doc] + nth * WINDOW
            used = np.minimum(size[doc] - nth * WINDOW, WINDOW)
            total = np.zeros((n, len(model.classes)))
            for a in range(0, len(doc), 1024):
                b = slice(a, a + 1024)
                at = begin[b, None] + np.arange(WINDOW)
                inside = np.arange(WINDOW) < used[b, None]
                x = np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)
                np.add.at(total, doc[b], model.predict(x) * used[b, None])
            seen = size > 0
            share = total[seen] / size[seen, None]
            lang[seen] = np.array(model.classes, dtype=object)[share.argmax(axis=1)]
            best[seen] = np.clip(share.max(axis=1), 0.0, 1.0)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(best, pa.float64())], ["lang_pred", "score"])

    return F.arrow_udf(score, "struct<lang_pred: string, score: double>")


def _predicted(model: ByteCNN | None, text: Column) -> Column:
    return _predictor(model)(F.coalesce(text, F.lit("")), has_letter(text))


def predict_language(docs: DataFrame, model: ByteCNN | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row. ``und`` with score 0 where the text is null or has no letter, or nothing was learned.

    All windows of all texts are read; repeated rows and null ids are scored like any other;
    an empty table gives an empty result.
    """
    found = docs.select(F.col(id_col).cast("long").alias("id"), _predicted(model, F.col(text_col)).alias("found"))
    return found.select("id", "found.lang_pred", "found.score")


def language_of(docs: DataFrame, model: ByteCNN | None, text_col: str = "text") -> DataFrame:
    """The input's rows with lang_pred and lang_score, see :func:`predict_language`; columns of those names are replaced."""
    docs = docs.drop("lang_pred", "lang_score", "lang_found")
    found = docs.withColumn("lang_found", _predicted(model, F.col(text_col)))
    return found.select(*docs.columns, F.col("lang_found.lang_pred").alias("lang_pred"), F.col("lang_found.score").alias("lang_score"))
