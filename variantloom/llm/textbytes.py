"""Texts as flat byte arrays: runs of texts in lower case, and hashes of their words."""

from __future__ import annotations

import numpy as np

END = 0xFF  # never a byte of UTF-8: ends a text and stands before it
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E), END]] = True
_RNG = np.random.default_rng(20240101)
_CODE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
CHUNK = 1 << 20


def bytes_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(texts, pa.ChunkedArray):
        texts = pa.chunked_array([pc.cast(c, pa.large_string()) for c in texts.chunks], pa.large_string()).combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    texts = pc.cast(texts, pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, depth: int, most: int):
    """(first text, bytes, where each text's padded stretch begins) of runs of texts of about CHUNK bytes.

    A stretch is ``depth`` END bytes, the text in lower case, and an END byte.
    """
    n, a = len(offsets) - 1, 0
    while a < n:
        b = min(n, a + most, max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1))
        size = np.diff(offsets[a : b + 1])
        begin = np.concatenate([[0], np.cumsum(size + depth + 1)])
        out = np.full(begin[-1], END, dtype=np.uint8)
        at = np.repeat(begin[:-1] + depth - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out[at] = _LOWER[data[offsets[a] : offsets[b]]]
        yield a, out, begin
        a = b


def word_hashes(x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(63-bit hashes of the words, text of each)."""
    return spans(x, begin)[:2]


def spans(x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(63-bit hashes of the words, text of each, first byte, byte after the last)."""
    space = _SPACE[x]
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    last = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    with np.errstate(over="ignore"):
        power = np.full(len(x), _ODD)
        power[:1] = 1
        power = np.cumprod(power, dtype=np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[x] * power, dtype=np.uint64)])
        inverse = np.full(len(x), _ODD_INVERSE)
        inverse[:1] = 1
        inverse = np.cumprod(inverse, dtype=np.uint64)
        h = (total[last] - total[first]) * inverse[first] if len(first) else np.zeros(0, np.uint64)
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h >> np.uint64(1), np.searchsorted(begin, first, "right") - 1, first, last
