"""Token-id files: static range asymmetric numeral systems over interleaved lanes.

A file is a Parquet file whose rows are segments, in ascending order of the documents. A segment's payload is binary
and stands alone: one frequency table that all its blocks share, the index of its documents, and independent blocks.
A block's ids are dealt in turn to ``LANES`` coder states that step together; it has a checksum, and the states and the
word position at every ``STRIDE`` steps, so that decoding can begin at any of these and run in parallel.

Layout of a payload (little-endian): ``LLA1``; sizes of the three parts that follow; table (zlib: symbols as uint16,
frequencies as uint32); index (an Arrow stream of doc_id, length); blocks (each: count, lanes, steps, words, crc32 of
the ids as uint32, word positions, states, words).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, ship, text_bytes
from .tokens import encoder

MAGIC = b"LLA1"
#: Frequencies of a table add up to 2 to the power of this.
BITS = 18
#: Coder states lie between this and its square times two; words of 32 bits go in and out.
LOW = np.uint64(1 << 31)
LANES, STRIDE = 1024, 256
#: Ids of a block, and those after which a segment is closed behind a document.
BLOCK, SEGMENT = 1 << 20, 1 << 21
FILE_SCHEMA = "part int, seg int, n_ids long, n_docs long, payload binary"
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
#: Segments whose starts are sent to all workers (some 10 MB); beyond that payloads are joined by a shuffle.
BROADCAST_ROWS = 1 << 18
U64 = np.uint64


class Table:
    """Symbols with their frequencies, quantised so that each has one at least."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray):
        self.symbols, self.freqs = symbols.astype(np.uint16), freqs.astype(np.uint32)
        self.freq = np.zeros(1 << 16, dtype=U64)
        self.low = np.zeros(1 << 16, dtype=U64)
        self.freq[self.symbols] = self.freqs
        self.low[self.symbols] = np.concatenate(([0], np.cumsum(self.freqs)[:-1]))

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        counts = np.bincount(ids, minlength=1)
        symbols = np.flatnonzero(counts)
        freqs = 1 + counts[symbols] * ((1 << BITS) - len(symbols)) // len(ids)
        freqs[np.argmax(freqs)] += (1 << BITS) - freqs.sum()
        return cls(symbols, freqs)

    def dump(self) -> bytes:
        return zlib.compress(struct.pack("<I", len(self.symbols)) + self.symbols.tobytes() + self.freqs.tobytes(), 6)

    @classmethod
    def load(cls, raw: bytes) -> Table:
        raw = zlib.decompress(raw)
        n = struct.unpack_from("<I", raw)[0]
        return cls(np.frombuffer(raw, np.uint16, n, 4), np.frombuffer(raw, np.uint32, n, 4 + 2 * n))

    def by_slot(self) -> np.ndarray:
        return np.repeat(self.symbols, self.freqs)


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    lanes = min(LANES, max(1, len(ids) // 64))
    steps = -(-len(ids) // lanes)
    grid = np.full(steps * lanes, table.symbols[np.argmax(table.freqs)], dtype=np.uint16)
    grid[: len(ids)] = ids
    grid = grid.reshape(steps, lanes)
    x = np.full(lanes, LOW, dtype=U64)
    words, sent, states, left = [], 0, [], []
    shift, down = U64(BITS), U64(32)
    for step in range(steps - 1, -1, -1):
        f, low = table.freq[grid[step]], table.low[grid[step]]
        out = x >= (f << U64(63 - BITS))
        emitted = x[out]
        words.append(emitted.astype(np.uint32))
        sent += len(emitted)
        x[out] = emitted >> down
        q, r = np.divmod(x, f)
        x = (q << shift) + r + low
        if step % STRIDE == 0:
            states.append(x.copy())
            left.append(sent)
    at = np.array([sent - n for n in reversed(left)], dtype=np.uint32)
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    body = at.tobytes() + np.concatenate(states[::-1]).tobytes() + np.concatenate(words[::-1]).tobytes()
    return struct.pack("<IIIII", len(ids), lanes, steps, sent, crc) + body


def decode_steps(words: np.ndarray, at: int, x: np.ndarray, steps: int, table: Table, slots: np.ndarray) -> np.ndarray:
    """Ids of ``steps`` steps from the checkpoint with states ``x`` and word position ``at``."""
    out = np.empty((steps, len(x)), dtype=np.uint16)
    x, mask, shift, up = x.copy(), U64((1 << BITS) - 1), U64(BITS), U64(32)
    for step in range(steps):
        slot = x & mask
        got = slots[slot]
        out[step] = got
        x = table.freq[got] * (x >> shift) + slot - table.low[got]
        need = x < LOW
        n = int(np.count_nonzero(need))
        x[need] = (x[need] << up) | words[at : at + n]
        at += n
    return out


def decode_block(raw: memoryview, table: Table, slots: np.ndarray) -> tuple[np.ndarray, int]:
    """The ids of the block at the start of ``raw`` and its length; every stretch starts from its own checkpoint."""
    n, lanes, steps, n_words, crc = struct.unpack_from("<IIIII", raw)
    marks = -(-steps // STRIDE)
    at = np.frombuffer(raw, np.uint32, marks, 20)
    states = np.frombuffer(raw, U64, marks * lanes, 20 + 4 * marks).reshape(marks, lanes)
    base = 20 + 4 * marks + 8 * marks * lanes
    words = np.frombuffer(raw, np.uint32, n_words, base).astype(U64)
    out = [decode_steps(words, int(at[i]), states[i], min(STRIDE, steps - i * STRIDE), table, slots) for i in range(marks)]
    ids = np.concatenate(out).reshape(-1)[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a block's ids do not match its checksum")
    return ids, base + 4 * n_words


def encode_segment(docs: list[int | None], pieces: list[np.ndarray]) -> bytes:
    ids = np.concatenate(pieces)
    table = Table.of(ids)
    batch = pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([len(p) for p in pieces], pa.int64())], ["doc_id", "length"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    head, index = table.dump(), zlib.compress(sink.getvalue(), 6)
    blocks = b"".join(encode_block(ids[a : a + BLOCK], table) for a in range(0, len(ids), BLOCK))
    return MAGIC + struct.pack("<III", len(head), len(index), len(blocks)) + head + index + blocks


def decode_segment(raw: bytes) -> tuple[list[int | None], list[int], np.ndarray]:
    """Documents, their numbers of ids, and all ids."""
    if raw[:4] != MAGIC:
        raise ValueError("not a segment")
    a, b, c = struct.unpack_from("<III", raw, 4)
    table = Table.load(raw[16 : 16 + a])
    index = pa.ipc.open_stream(zlib.decompress(raw[16 + a : 16 + a + b])).read_all()
    view, slots, ids = memoryview(raw)[16 + a + b : 16 + a + b + c], table.by_slot(), []
    while view:
        got, n = decode_block(view, table, slots)
        ids.append(got)
        view = view[n:]
    return index["doc_id"].to_pylist(), index["length"].to_pylist(), np.concatenate(ids)


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts, the end id behind each, to new files at ``path`` in ascending order of the documents.

    Defined cases: a null or empty text is its end id alone; a null id comes first; rows of one id are each written, in
    a fixed order; an empty table leaves a folder without segments; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seg = TaskContext.get().partitionId(), 0
        ids, pieces, held = [], [], 0

        def close() -> pa.RecordBatch:
            row = [[part], [seg], [held], [len(ids)], [encode_segment(ids, pieces)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["part", "seg", "n_ids", "n_docs", "payload"])

        for batch in batches:
            for a, b, every, borders in encoder(vocabulary).runs(batch.column(1)):
                for doc, begin, to in zip(batch.column(0).slice(a, b - a).to_pylist(), borders.tolist(), borders[1:].tolist()):
                    ids.append(doc)
                    pieces.append(np.append(every[begin:to], np.uint16(end_id)))
                    held += len(pieces[-1])
                    if held >= SEGMENT:
                        yield close()
                        ids, pieces, held, seg = [], [], 0, seg + 1
        if ids:
            yield close()

    spark = ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(partitions(spark), "doc_id", tie).sortWithinPartitions("doc_id", tie)
    # payloads are coded already
    ordered.mapInArrow(run, FILE_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document: id, ids (little-endian unsigned 32-bit), and the ids of all documents before it."""
    files = ship(spark).read.schema(FILE_SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, payload in zip(*(batch.column(i).to_pylist() for i in range(2))):
                docs, lengths, ids = decode_segment(payload)
                ends = np.cumsum(lengths)
                for a in range(0, len(docs), 2048):
                    b = min(len(docs), a + 2048)
                    starts = (ends[a:b] - lengths[a:b]).tolist()
                    raw = [ids[s : s + n].tobytes() for s, n in zip(starts, lengths[a:b])]
                    columns = [docs[a:b], [before + s for s in starts], lengths[a:b], raw]
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in READ_SCHEMA.split(", ")])

    # what comes before a segment: the parts before its own, of which there are as many as the writer had tasks, and the
    # part's segments before it
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier(Window.orderBy("part"))), F.lit(0)).alias("before_part"))
    inside = F.coalesce(F.sum("n_ids").over(earlier(Window.partitionBy("part").orderBy("seg"))), F.lit(0))
    starts = files.select("part", "seg", inside.alias("before")).join(parts, "part").select("part", "seg", (F.col("before_part") + F.col("before")).alias("before"))
    starts = F.broadcast(starts) if files.count() <= BROADCAST_ROWS else starts
    return files.select("part", "seg", "payload").join(starts, ["part", "seg"]).select("before", "payload").mapInArrow(run, READ_SCHEMA)
