"""Periodic runs of words: maximal stretches that repeat with a period, by Lyndon words.

Every run's period is the length of a Lyndon word that starts in it, under the order of the words
or its reverse, and that Lyndon word is the longest one at its place. So the text is scanned
from right to left once under each order, with a stack of the Lyndon words found so far; two
suffixes are compared by the length of their common beginning, found by binary search over
rolling hashes, and each Lyndon word is extended to both sides in the same way. The word after
a common beginning is compared itself, and every run is verified word by word before it counts,
so that a collision of hashes can't make one up.

Stretches without a run are put aside first: a run of three periods or more holds each of its
words three times, so a text is cut at words that occur less often, and its pieces are cut
again until nothing changes. Runs never cross such a cut.
"""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import batch_words

MODULUS = (1 << 61) - 1
BASE = random.Random(20250117).randrange(1 << 32, MODULUS)
EMPTY = hashlib.sha256(b"").hexdigest()


class Prefixes:
    """Rolling hashes of a list of word numbers, and the common beginnings and ends they tell."""

    def __init__(self, words: list[int]):
        self.words = words
        power, total = [1], [0]
        p, t = 1, 0
        for w in words:
            p = p * BASE % MODULUS
            t = (t * BASE + w + 1) % MODULUS
            power.append(p)
            total.append(t)
        self.power, self.total = power, total

    def forward(self, i: int, j: int) -> int:
        """Length of the common beginning of the suffixes at ``i`` < ``j``."""
        w = self.words
        most = len(w) - j
        if most <= 0 or w[i] != w[j]:
            return 0
        power, total = self.power, self.total
        at_i, at_j = total[i], total[j]
        low, step = 1, 2  # words i .. i + low are equal; doubled steps first, as most beginnings are short
        while low + step <= most and not (total[i + low + step] - total[j + low + step] - (at_i - at_j) * power[low + step]) % MODULUS:
            low += step
            step *= 2
        high = min(most, low + step - 1) if low + step <= most else most
        while low < high:
            mid = (low + high + 1) // 2
            if (total[i + mid] - total[j + mid] - (at_i - at_j) * power[mid]) % MODULUS:
                high = mid - 1
            else:
                low = mid
        return low

    def backward(self, i: int, j: int) -> int:
        """Length of the common end of the prefixes that stop before ``i`` < ``j``."""
        w = self.words
        if i <= 0 or w[i - 1] != w[j - 1]:
            return 0
        power, total = self.power, self.total
        gap = total[i] - total[j]
        low, high = 1, i
        while low < high:
            mid = (low + high + 1) // 2
            if (gap - (total[i - mid] - total[j - mid]) * power[mid]) % MODULUS:
                high = mid - 1
            else:
                low = mid
        return low


def lyndon_ends(prefixes: Prefixes, sign: int) -> list[int]:
    """For every place the end of the longest Lyndon word that starts there, the words' order turned if ``sign`` is -1."""
    w = prefixes.words
    n = len(w)
    ends = [n] * n
    forward = prefixes.forward
    stack: list[int] = []  # starts of the Lyndon words to the right, the nearest on top
    for i in range(n - 1, -1, -1):
        a = w[i]
        while stack:
            j = stack[-1]
            b = w[j]
            if a == b:
                m = forward(i, j)
                if j + m >= n:  # the suffix at j ends first, so it is the smaller one under either order
                    break
                smaller = sign * (w[i + m] - w[j + m]) < 0
            else:
                smaller = sign * (a - b) < 0
            if not smaller:
                break
            stack.pop()
        ends[i] = stack[-1] if stack else n
        stack.append(i)
    return ends


def runs(words: list[int], shortest: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``shortest`` words and ``times`` (2 or more) periods, by start, then period."""
    n = len(words)
    if n < shortest:
        return []
    prefixes = Prefixes(words)
    found: dict[tuple[int, int], int] = {}
    for sign in (1, -1):
        done = [-1, -1]  # a run has the same Lyndon word once a period: its later places are passed over
        for i, j in enumerate(lyndon_ends(prefixes, sign)):
            period = j - i
            if j >= n or period * times > n or (period == done[0] and j < done[1]) or words[i] != words[j] and (i == 0 or words[i - 1] != words[j - 1]):
                continue
            right = prefixes.forward(i, j)
            left = prefixes.backward(i, j)
            start, length = i - left, left + period + right
            if left + right < period:
                continue
            done = [period, start + length]
            if length >= max(shortest, times * period):
                found[start, period] = length
    fine = []
    for (start, period), length in sorted(found.items()):
        end = start + length
        if words[start : end - period] != words[start + period : end]:
            raise ArithmeticError(f"rolling hashes collide in a run at {start} with period {period}")
        fine.append((start, length, period))
    return fine


def candidates(numbers: np.ndarray, owner: np.ndarray, shortest: int, times: int) -> list[tuple[int, int]]:
    """Stretches (from, to) of one owner that may hold runs: every word occurs ``times`` times in its stretch."""
    piece, at = owner.astype(np.int64), np.arange(len(numbers))
    kinds = int(numbers.max(initial=0)) + 1
    while len(at):
        _, inverse, counts = np.unique(piece * kinds + numbers[at], return_inverse=True, return_counts=True)
        alive = counts[inverse] >= times
        at, piece = at[alive], piece[alive]
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (np.diff(at) != 1) | (np.diff(piece) != 0)
        cut = np.cumsum(fresh) - 1
        long_ = np.bincount(cut, minlength=1)[cut] >= shortest if len(at) else np.zeros(0, dtype=bool)
        if alive.all() and long_.all():
            first = np.flatnonzero(fresh)
            return list(zip(at[first].tolist(), (at[np.append(first[1:], len(at)) - 1] + 1).tolist()))
        at, piece = at[long_], cut[long_]
    return []


def best_of(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, exactly; ties go to the smallest start, then period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def repeated_tail(doc_id, n: int) -> np.ndarray:
    """Where each of a document's ``n`` words comes from: for every tenth id (by crc32) the words from some place on repeat."""
    place = np.arange(n)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        place[a:] = a + (place[a:] - a) % p
    return place


def _scan(shortest: int, times: int, repeat_tails: bool, texts_out: bool, at_once: int = 1 << 20):
    import pyarrow as pa
    import pyarrow.compute as pc

    def scanned(ids, texts):
        numbers, offsets, words = batch_words(texts)
        if repeat_tails:
            sizes = np.diff(offsets).tolist()
            numbers = numbers[np.concatenate([np.zeros(0, dtype=np.int64), *(o + repeated_tail(i, n) for i, o, n in zip(ids, offsets.tolist(), sizes))])] if len(ids) else numbers
        owner = np.repeat(np.arange(len(ids)), np.diff(offsets))
        own: list[list] = [[] for _ in ids]
        keep = np.ones(len(numbers), dtype=bool)
        for a, b in candidates(numbers, owner, shortest, times):
            doc = int(owner[a])
            for start, length, period in runs(numbers[a:b].tolist(), shortest, times):
                own[doc].append((a + start - int(offsets[doc]), length, period))
                keep[a + start + period : a + start + length] = False
        for found in own:
            found.sort(key=lambda r: (r[0], r[2]))
        ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words, pa.large_string()).take(pa.array(numbers[keep])))
        return own, pc.binary_join(lists, pa.scalar(" ", pa.large_string())).to_pylist()

    def run(batches):
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(size) // at_once
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                ids = batch.column(0).slice(a, b - a).to_pylist()
                own, collapsed = scanned(ids, batch.column(1).slice(a, b - a))
                best = [best_of(x) for x in own]
                pick = lambda i: pa.array([None if r is None else r[i] for r in best], pa.int64())  # noqa: E731, B023
                columns = {
                    "id": pa.array(ids, pa.int64()),
                    "n_runs": pa.array([len(x) for x in own], pa.int64()),
                    "start": pick(0),
                    "length": pick(1),
                    "period": pick(2),
                    "exponent_milli": pa.array([None if r is None else 1000 * r[1] // r[2] for r in best], pa.int64()),
                    "runs_sha256": pa.array([hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in x).encode()).hexdigest() if x else EMPTY for x in own]),
                    "collapsed_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in collapsed]),
                }
                if texts_out:
                    columns["runs"] = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in x] for x in own], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
                    columns["collapsed"] = pa.array(collapsed, pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 24, times: int = 3, repeat_tails: bool = False, texts_out: bool = True) -> DataFrame:
    """One row per document: id, n_runs, its strongest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256; with ``texts_out`` also runs and collapsed.

    Words are cut at ASCII white space and numbered from 0. A run has at least ``shortest``
    words and ``times`` periods (3 or more: stretches without such runs are put aside by that).
    ``collapsed`` is the text without each run's words after its first period, joined by single
    spaces. A null text is empty; a text without runs has n_runs 0 and nulls for the strongest
    run; a null id is kept; repeated rows are rows of their own; an empty table gives no rows.
    ``repeat_tails`` has the words of every tenth document (by crc32 of its id) repeat first.
    Rows are independent: nothing is shuffled, and a task holds about 1 MB of text at once, or
    one text if that is longer.
    """
    if times < 3 or shortest < 2:
        raise ValueError("runs of at least three periods and two words")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    if texts_out:
        schema += ", runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(_scan(shortest, times, repeat_tails, texts_out), schema)
