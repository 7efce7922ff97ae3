"""Fingerprints of documents by consistent weighted sampling.

A document is a weighted set: its words in lower case, each weighing as often as it occurs
times its length in bytes. For every sample each word draws, from a hash of the word and the
sample's number alone, r and c from Gamma(2, 1) and b from [0, 1). A word of weight w has
t = floor(ln w / r + b), ln y = r (t - b) and the value ln a = ln c - ln y - r; the word of the
smallest value and its t are the sample. Two documents agree in a sample with probability
sum of min(w, w') / sum of max(w, w'), the generalised Jaccard similarity of their sets.

A sample is stored as 16 bits of a hash of (word, t), so that unequal ones agree by chance once
in 65,536.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textbytes import bytes_of, chunks, spans

_SEED = np.uint64(0xD1B54A32D192ED03)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BITS = np.uint64((1 << 24) - 1)
_CODE = np.uint64(0xFFFF)
_RUN = 1 << 14  # words whose draws are worked out at once: they stay in the processor's cache


def _mixed(h: np.ndarray) -> np.ndarray:
    """The hashes mixed, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _logs(h: np.ndarray) -> np.ndarray:
    """-ln(u v), Gamma(2, 1), of two numbers in (0, 1] of 24 bits each."""
    u = (h & _BITS).astype(np.float32)
    u += np.float32(1)
    v = ((h >> np.uint64(24)) & _BITS).astype(np.float32)
    v += np.float32(1)
    u *= v
    u *= np.float32(2.0**-48)
    np.log(u, out=u)
    return np.maximum(np.negative(u, out=u), np.float32(1e-7), out=u)


def draws(words: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, ln c, b) that each word (a hash) draws for ``sample``, in single precision."""
    with np.errstate(over="ignore"):
        one = _mixed(words + _SEED * np.uint64(2 * sample + 1))
        two = _mixed(words + (_SEED * np.uint64(2 * sample + 1) ^ _STEP))
    b = (((one >> np.uint64(48)) << np.uint64(8)) | (two >> np.uint64(56))).astype(np.float32)
    b *= np.float32(2.0**-24)
    log_c = _logs(two)
    return _logs(one), np.log(log_c, out=log_c), b


def _ranked(words: np.ndarray, log_w: np.ndarray, sample: int) -> np.ndarray:
    """For words of given log weights a number each, in the order of ln a, whose low 16 bits tell (word, t)."""
    r, value, b = draws(words, sample)
    t = log_w / r
    t += b
    np.floor(t, out=t)
    value -= r
    np.subtract(t, b, out=b)
    b *= r
    value -= b
    with np.errstate(over="ignore"):
        code = t.astype(np.int64).view(np.uint64)
        code *= _STEP
        code += np.uint64(sample)
        code ^= words
        code = _mixed(code) >> np.uint64(48)
    bits = value.view(np.int32)
    bits ^= (bits >> np.int32(31)) & np.int32(0x7FFFFFFF)  # in the order of the floats
    order = (bits.astype(np.int64) + (1 << 31)).view(np.uint64)
    return (order << np.uint64(16)) | code


def sampled(owner: np.ndarray, words: np.ndarray, amount: np.ndarray, owners: int, samples: int) -> np.ndarray:
    """uint16 [owners, samples]; ``owner``, ``words`` (hashes) and ``amount`` are those of every occurrence. An owner without words has zeros."""
    out = np.zeros((owners, samples), dtype=np.uint16)
    if not len(words):
        return out
    term, kinds = pd.factorize(words)
    order = owner.astype(np.int64) * len(kinds) + term
    each, counts = np.unique(order, return_counts=True)
    size = np.zeros(len(kinds), dtype=np.int64)
    size[term] = amount
    doc, term = each // len(kinds), each % len(kinds)
    weight = counts * size[term]
    # words of equal weight have equal values: those are worked out once
    most = int(weight.max()) + 1
    pair, inverse = np.unique(term * most + weight, return_inverse=True)
    pair_word, log_w = kinds[pair // most], np.log(pair % most).astype(np.float32)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    own = doc[first]
    key = np.zeros(len(pair), dtype=np.uint64)
    for k in range(samples):
        for a in range(0, len(pair), _RUN):
            key[a : a + _RUN] = _ranked(pair_word[a : a + _RUN], log_w[a : a + _RUN], k)
        out[own, k] = (np.minimum.reduceat(key[inverse], first) & _CODE).astype(np.uint16)
    return out


def fingerprints_of(texts: list[str], samples: int) -> np.ndarray:
    """uint16 [texts, samples]."""
    import pyarrow as pa

    data, offsets = bytes_of(pa.array(texts, pa.large_string()))
    owner, words, amount = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, x, begin in chunks(data, offsets, 1, 4096):
        h, of, first, last = spans(x, begin)
        owner.append(of + a)
        words.append(h.astype(np.uint64))
        amount.append(last - first)
    return sampled(np.concatenate(owner), np.concatenate(words), np.concatenate(amount), len(texts), samples)


def edited(text: str, other: str) -> str:
    """``text`` whose last third of code points gives way to the first as many (or all) of ``other``."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


_COLUMNS = "id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _rows(ids, texts, changed, own, after, both):
    """The result's columns: documents, their texts, edited texts, fingerprints, those of the documents after them and of the edited texts."""
    import pyarrow as pa

    share = lambda x, y: pa.array((x == y).mean(axis=1) if len(x) else [], pa.float64())
    flat = lambda x: pa.array([f.tobytes() for f in x], pa.binary())
    return [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).digest() for t in changed], pa.binary()),
        flat(own),
        flat(both),
        share(own, both),
        share(own, after),
    ]


def _in_order(samples: int, at_once: int = 1 << 22):
    """Rows (id, text) in order to results for all rows of the task but its last; its first and last row follow with their texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    names = [c.split()[0] for c in _COLUMNS.split(", ")] + ["part", "place", "text"]

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = None  # the last row so far: id, text, fingerprint

        def end(place, row):
            none = lambda kind: pa.nulls(1, kind)
            told = [pa.array([row[0]], pa.int64()), none(pa.int64()), none(pa.binary()), pa.array([row[2].tobytes()], pa.binary()), none(pa.binary()), none(pa.float64()), none(pa.float64())]
            return pa.RecordBatch.from_arrays([*told, pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([row[1]], pa.string())], names)

        for batch in batches:
            group = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)) // at_once
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                ids, texts = batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist()
                fresh, every = len(texts), texts if held is None else [held[1], *texts]
                changed = [edited(t, o) for t, o in zip(every[:-1], every[1:])]
                found = fingerprints_of(texts + changed, samples)  # both at once: they share most words
                prints, both = found[:fresh], found[fresh:]
                if held is None:
                    yield end(0, (ids[0], texts[0], prints[0]))
                else:
                    ids, prints = [held[0], *ids], np.concatenate([held[2][None], prints])
                held = ids[-1], every[-1], prints[-1]
                n = len(ids) - 1
                if n:
                    columns = _rows(ids[:-1], every[:-1], changed, prints[:-1], prints[1:], both)
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names)
        if held is not None:
            yield end(1, held)

    return run


def _ends(samples: int):
    """Rows (id, text, fingerprint, next_text, next_fingerprint) to results."""
    import pyarrow as pa

    names = [c.split()[0] for c in _COLUMNS.split(", ")]

    def run(batches):
        for batch in batches:
            ids, texts, own, others, nexts = (c.to_pylist() for c in batch.columns)
            array = lambda x: np.frombuffer(b"".join(x), dtype=np.uint16).reshape(len(x), samples)
            changed = [edited(t, o) for t, o in zip(texts, others)]
            yield pa.RecordBatch.from_arrays(_rows(ids, texts, changed, array(own), array(nexts), fingerprints_of(changed, samples)), names)

    return run


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = 128) -> DataFrame:
    """(id, fingerprint): two bytes a sample, for every row.

    A null text is empty; texts without words have an all-zero fingerprint; equal texts have
    equal fingerprints; null ids and repeated rows are kept; an empty table gives no rows.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            found = fingerprints_of(batch.column(1).to_pylist(), samples)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.tobytes() for f in found], pa.binary())], ["id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, fingerprint binary")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = 128) -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next.

    The documents stand in descending order of id (null ids last; rows of one id by a hash of
    their text, then the text), after the last comes the first. The edited text has its last
    third of code points replaced by the beginning of the next document. near_edited and
    near_next are the shares of samples that agree. A null text is empty; a single document is
    its own next one; an empty table gives no rows.

    Texts are dealt by ranges of that order, once. A task lacks only the document after its
    last one: each task's first and last document are written out, and joined by the number of
    the task, of which the driver sees the numbers alone.
    """
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    found = materialize(dealt.mapInArrow(_in_order(samples), f"{_COLUMNS}, part int, place int, text string"), "fingerprints")
    parts = sorted(r["part"] for r in found.filter("place = 0").select("part").collect())
    done = found.filter("place is null").drop("part", "place", "text")
    if parts:
        after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
        heads = found.filter("place = 0").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
        tails = found.filter("place = 1").select("id", "text", "fingerprint", "part").join(F.broadcast(after), "part").join(heads, "next_part")
        done = done.unionByName(tails.select("id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(_ends(samples), _COLUMNS))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return done.select("id", "n_chars", text("edited_sha256"), text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next")
