"""Packing documents into token windows by Karmarkar-Karp multiway differencing.

Documents are tokenized and cut into whole windows and a rest. Batches of rests are
partitioned into windows of near-equal load: the two partial partitions with the widest
spread are merged again and again, the fullest part of one with the emptiest of the other.
If the fullest window of the result exceeds the capacity, the batch gets one window more.
One document in ``filler_every`` has its rest cut into small fillers, which level the loads.
"""

from __future__ import annotations

import heapq
import zlib
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def cut(tokens: int, window: int, filler: int, fine: bool) -> list[int]:
    """Lengths of a document's pieces: whole windows, then the rest, in fillers if ``fine``."""
    whole, rest = divmod(tokens, window)
    step = filler if fine else window
    return [window] * whole + [step] * (rest // step) + ([rest % step] if rest % step else [])


def differencing(sizes: np.ndarray, parts: int) -> list[list[int]]:
    """Items dealt into ``parts`` parts of near-equal sums (Karmarkar-Karp over any number of parts).

    A partial partition is its parts that are not empty, (sum, tree of items), fullest first.
    """
    total = itemgetter(0)
    heap = [(-n if parts > 1 else 0, i, [(n, i)]) for i, n in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    stamp = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = len(a) + len(b) - parts
        if both > 0:  # the fullest of one meet the emptiest of the other: opposing imbalances
            low_a, low_b = a[len(a) - both :], b[len(b) - both :]
            met = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(low_a, reversed(low_b))]
            merged = a[: len(a) - both] + b[: len(b) - both] + met
        else:
            merged = a + b
        merged.sort(key=total, reverse=True)
        spread = merged[0][0] - (merged[-1][0] if len(merged) == parts else 0)
        heapq.heappush(heap, (-spread, stamp, merged))
        stamp += 1
    return [_leaves(tree) for _, tree in heap[0][2]] if heap else []


def _leaves(tree) -> list[int]:
    found, todo = [], [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            todo.extend(x)
        else:
            found.append(x)
    return found


def windows(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items dealt into windows none of which exceeds ``capacity``; no item may exceed it."""
    parts = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = differencing(sizes, parts)
        if all(sizes[x].sum() <= capacity for x in found):
            return found
        parts += 1


def _pieces(path: str, end_id: int, window: int, filler: int, filler_every: int, keep_ids: bool):
    import pyarrow as pa

    def run(batches):
        from .tokens import encoder

        enc, row = encoder(path), 0
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                ids, starts = enc.encode(part.column(1))
                out: dict[str, list] = {k: [] for k in ("id", "start", "length", "ids_crc32", "doc_tokens", "salt", "ids")}
                for i, doc in enumerate(part.column(0).to_pylist()):
                    own = np.append(ids[starts[i] : starts[i + 1]], end_id).astype("<u4")
                    at = 0
                    fine = zlib.crc32(str(doc).encode()) % filler_every == 0
                    for n in cut(len(own), window, filler, fine):
                        out["id"].append(doc)
                        out["start"].append(at)
                        out["length"].append(n)
                        out["ids_crc32"].append(zlib.crc32(own[at : at + n].tobytes()))
                        out["doc_tokens"].append(len(own))
                        out["salt"].append(row)
                        if keep_ids:
                            out["ids"].append(own[at : at + n].astype(np.int32))
                        at += n
                        row += 1
                kinds = [pa.int64()] * 6 + ([pa.list_(pa.int32())] if keep_ids else [])
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out)[: len(kinds)])

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    end_id: int = 1,
    batch_pieces: int = 1000,
    filler: int = 128,
    filler_every: int = 8,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if ``keep_ids``.

    A document is its ids and then ``end_id``; a null text is empty, so every row has at least
    one id. Repeated rows are packed as often as they occur; an empty table gives an empty
    result. ``tokenizer`` is a path that every executor has. Batches are dealt by a hash of
    the piece, about ``batch_pieces`` each, so none grows with the table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, salt long" + (", ids array<int>" if keep_ids else "")
    pieces = materialize(rows.mapInArrow(_pieces(tokenizer, end_id, window, filler, filler_every, keep_ids), schema), "pieces")
    batches = max(1, -(-pieces.count() // batch_pieces))

    def deal(pdf):
        pdf = pdf.sort_values(["id", "start", "salt"], kind="stable").reset_index(drop=True)
        size = pdf["length"].to_numpy()
        full, rest = np.flatnonzero(size == window), np.flatnonzero(size < window)
        sequence, offset = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
        sequence[full] = np.arange(len(full))
        for n, items in enumerate(windows(size[rest], window)):
            at = rest[sorted(items)]
            sequence[at] = len(full) + n
            offset[at] = np.cumsum(size[at]) - size[at]
        pdf["sequence_id"] = pdf["batch"] * (1 << 20) + sequence
        pdf["offset"] = offset
        return pdf.drop(columns=["batch", "salt"])

    out = "id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if keep_ids else "") + ", sequence_id long, offset long"
    spot = F.pmod(F.xxhash64("id", "start", "salt"), F.lit(batches))
    return pieces.withColumn("batch", spot).groupBy("batch").applyInPandas(deal, out)
