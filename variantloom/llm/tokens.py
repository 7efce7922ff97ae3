"""Token ids of whole batches of text, word by word.

The tokenizer's pre-tokenizer never joins across white space, so a text's ids are those of its
white-space pieces in a row. Each distinct piece is encoded once per Python worker and kept.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import batch_words

#: Pieces of these characters split at letters, digits and the rest alike in any context.
_PLAIN = re.compile(r"(?!.*<\|)[A-Za-z0-9À-ÖØ-öø-ÿĀ-įı-ž!-&(-/:-@\[-`{-~]+")
_PARTS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿĀ-įı-ž]+|[0-9]|[^A-Za-zÀ-ÖØ-öø-ÿĀ-įı-ž0-9]+")
KEPT = 500_000  # strings a worker keeps of each kind: some tens of MB


class _Table:
    """Lists of ids by string: a flat array with where each starts and how long it is."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.start, self.size = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.at)
        while n + len(keys) > len(self.start):
            self.start, self.size = np.append(self.start, np.zeros_like(self.start)), np.append(self.size, np.zeros_like(self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n : n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(keys)] = sizes
        self.at.update(zip(keys, range(n, n + len(keys))))
        self.used += len(ids)

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[numbers]
        where = np.repeat(self.start[numbers] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.flat[where], size


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        if suffix:
            for token, i in self.tokenizer.get_vocab().items():
                self.ends[i] = token.endswith(suffix)
        self.suffix = bool(suffix)
        self.pieces, self.parts = _Table(), _Table()

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in found for i in x], dtype=np.int32), np.array([len(x) for x in found], dtype=np.int64)

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many parts in one call, told apart by the tokens that end a word."""
        ids, _ = self._encode([" ".join(parts[i : i + 1000]) for i in range(0, len(parts), 1000)])
        last = np.flatnonzero(self.ends[ids]) + 1
        if not self.suffix or len(last) != len(parts):
            return self._encode(parts)
        return ids, np.diff(last, prepend=0)

    def _learn(self, new: list[str]) -> None:
        plain = [w for w in new if _PLAIN.fullmatch(w)]
        split = [_PARTS.findall(w.lower()) for w in plain]
        fresh = [p for p in dict.fromkeys(p for x in split for p in x) if p not in self.parts.at]
        if len(self.parts.at) + len(fresh) > KEPT:
            self.parts = _Table()
            fresh = list(dict.fromkeys(p for x in split for p in x))
        if fresh:
            self.parts.add(fresh, *self._encode_parts(fresh))
        if plain:
            at = self.parts.at
            ids, size = self.parts.take(np.array([at[p] for x in split for p in x], dtype=np.int64))
            ends = np.cumsum([len(x) for x in split])
            total = np.concatenate([[0], np.cumsum(size)])[ends]
            self.pieces.add(plain, ids, np.diff(total, prepend=0))
        rest = [w for w in new if not _PLAIN.fullmatch(w)]
        if rest:
            self.pieces.add(rest, *self._encode(rest))

    def _words(self, texts: pa.Array, table: str, learn) -> tuple[np.ndarray, np.ndarray]:
        numbers, offsets, words = batch_words(texts)
        if len(getattr(self, table).at) > KEPT:
            setattr(self, table, _Table())
        at = getattr(self, table).at
        new = [w for w in words if w not in at]
        if new:
            learn(new)
        at = getattr(self, table).at
        ids, size = getattr(self, table).take(np.array([at[w] for w in words], dtype=np.int64)[numbers] if words else np.zeros(0, np.int64))
        return ids, np.concatenate([[0], np.cumsum(size)])[offsets]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text begins and the end)."""
        easy = _easy(texts)
        if easy.all():
            spaced = pc.replace_substring_regex(pc.utf8_lower(texts), _APART, r" \1 ")
            return self._words(spaced, "parts", lambda new: self.parts.add(new, *self._encode_parts(new)))
        if not easy.any():
            return self._words(texts, "pieces", self._learn)
        at = np.flatnonzero(easy), np.flatnonzero(~easy)
        found = [self.encode(texts.take(pa.array(x))) for x in at]
        size, begin = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        shift = 0
        for x, (ids, offsets) in zip(at, found):
            size[x], begin[x] = np.diff(offsets), offsets[:-1] + shift
            shift += len(ids)
        ids = np.concatenate([x[0] for x in found])
        offsets = np.concatenate([[0], np.cumsum(size)])
        return ids[np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])], offsets


def _easy(texts: pa.Array) -> np.ndarray:
    """Texts of ASCII and Latin letters without apostrophes or ``<|``: lower case and cuts between classes of characters are alike everywhere in them."""
    texts = pc.cast(texts, pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    odd = _ODD[data]
    odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
    odd[:-1] |= (data[:-1] == 0xC4) & (data[1:] == 0xB0)
    odd[:-1] |= (data[:-1] == 0xC5) & (data[1:] > 0xBE)
    total = np.concatenate([[0], np.cumsum(odd)])
    return np.diff(total[offsets - offsets[0]]) == 0


_ODD = np.zeros(256, dtype=bool)
_ODD[0xC6:] = _ODD[0xC0:0xC3] = True
_ODD[[*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F, ord("'")]] = True
_APART = r"([^A-Za-zÀ-ÖØ-öø-ž0-9\s]+|[0-9])"


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
