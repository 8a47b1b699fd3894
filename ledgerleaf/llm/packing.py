"""Packing of token ids into windows by Karmarkar-Karp multiway differencing.

Every document's ids, the end id behind them, are cut into full windows and a rest; rests are cut again into pieces of
at most ``piece`` ids. A task gathers pieces until they fill ``cell`` windows, and deals each such cell to as few
windows as hold them: differencing merges partial partitions whose imbalances oppose each other, and the window count
rises by one whenever a window of the result exceeds the capacity. Nothing is shuffled, a task holds one cell and one
document, and a lost task gives the same windows when it runs again.

Defined cases: a null or empty text is its end id alone; repeated rows and ties are packed each; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_bytes
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """``k`` groups of indices into ``sizes`` with nearly equal sums.

    A partial partition is its non-empty groups, largest first. The two of largest imbalance merge, the largest group
    of one with the smallest of the other, until one partition is left.
    """
    if not sizes:
        return [[] for _ in range(k)]
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        alone = k - len(b)
        merged = a[:alone]
        for i, (size, items) in enumerate(reversed(b), alone):
            merged.append((size + a[i][0], a[i][1] + items) if i < len(a) else (size, items))
        merged.sort(key=lambda g: -g[0])
        low = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (low - merged[0][0], serial, merged))
        serial += 1
    groups = [items for _, items in heap[0][2]]
    return groups + [[] for _ in range(k - len(groups))]


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of indices into ``sizes``, each of at most ``capacity`` in sum and nearly equal."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = [g for g in differencing(sizes, k) if g]
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return groups
        k += 1


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, piece: int = 512, cell: int = 96,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row for each piece: its document, place there, ids (little-endian unsigned 32-bit), window and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 40
        full, rests, held = [], [], 0

        def rows(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal serial, held
            out = []
            for group in windows_of([r[2] for r in rests], capacity):
                at = 0
                for i in group:
                    out.append((*rests[i], serial, at))
                    at += rests[i][2]
                serial += 1
            rests.clear()
            held = 0
            if out:
                yield rows(out)

        for batch in batches:
            for a, b, every, borders in encoder(vocabulary).runs(batch.column(1)):
                for doc, begin, to in zip(batch.column(0).slice(a, b - a).to_pylist(), borders.tolist(), borders[1:].tolist()):
                    ids = np.append(every[begin:to], np.uint16(end_id)).astype("<u4")
                    n = len(ids)
                    edge = n - n % capacity
                    for at in range(0, edge, capacity):
                        full.append((doc, at, capacity, ids[at : at + capacity].tobytes(), n, serial, 0))
                        serial += 1
                        if len(full) >= 512:
                            yield rows(full)
                            full.clear()
                    cuts = max(1, -(-(n - edge) // piece))
                    edges = [edge + (n - edge) * i // cuts for i in range(cuts + 1)]
                    for p, q in zip(edges, edges[1:]):
                        if q > p:
                            rests.append((doc, p, q - p, ids[p:q].tobytes(), n))
                            held += q - p
                    if held >= cell * capacity:
                        yield from close()
        if full:
            yield rows(full)
        yield from close()

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(run, SCHEMA)
