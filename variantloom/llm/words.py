"""Words of a batch of texts as numbers into the batch's own dictionary, by Arrow kernels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def batch_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(word numbers, first word of each text and the end, dictionary); words are cut at ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.cast(texts, pa.large_string()))
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    encoded = pc.dictionary_encode(lists.values)
    numbers = np.asarray(encoded.indices, dtype=np.int64)
    words = encoded.dictionary.to_pylist()
    # splitting leaves empty strings at a text's ends
    if "" in words:
        keep = numbers != words.index("")
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        numbers = numbers[keep]
    return numbers, offsets, words
