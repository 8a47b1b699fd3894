"""Benchmark decontamination by one Aho-Corasick automaton over normalised benchmark windows.

Texts are normalised to lower-case words with one space between; every window of ``width`` consecutive words of an
item (a shorter item is one window) is a pattern, and a text is scanned once for all of them. Positions in the
normalised text lead back to words and to code points of the original.

The patterns go to the workers in blocks whose bytes are bounded by ``block_bytes``; a benchmark of one block, the usual
case, needs no shuffle, and with more of them each text is scanned once for each block and the finds are merged by text.

Defined cases: a null or empty text has no words and no hits; a null or wordless item has no windows; windows of an item
without an id are hit, but name no item; repeated items count by their ids; repeated texts are each judged; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, stored, text_bytes

#: Upper case to lower case, and every byte that belongs to no word to a space. Bytes from 0x80 on belong to words.
TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
SCHEMA = "row long, doc_id long, n_words long, hits array<struct<start:long,end:long>>, items array<long>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


def windows_of(text: bytes, width: int) -> set[bytes]:
    words = words_of(text)
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def _automaton(patterns: dict[bytes, list[int]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for pattern, items in patterns.items():
        a.add_word(f" {pattern.decode('latin-1')} ", (pattern.count(b" ") + 1, len(pattern), items))
    a.make_automaton()
    return a


_built: dict[str, object] = {}


def _built_once(patterns: Broadcast):
    """The automaton of a broadcast block, built once in each worker."""
    value = patterns.value
    if _built.get("of") is not value:
        _built.update(of=value, automaton=_automaton(value))
    return _built["automaton"]


def scan(automaton, text: bytes) -> tuple[list[bytes], set[int], set[int]]:
    """Words, positions of hit words, items with a window in the text."""
    words = words_of(text)
    if not words:
        return words, set(), set()
    normal = " " + b" ".join(words).decode("latin-1") + " "
    hit, items, starts = set(), set(), None
    for last, (n, length, found) in automaton.iter(normal):
        if starts is None:
            starts = np.cumsum([0] + [len(w) + 1 for w in words])
        first = int(np.searchsorted(starts, last - length - 1))
        hit.update(range(first, first + n))
        items.update(found)
    return words, hit, items


def _spans(positions: list[int]) -> list[tuple[int, int]]:
    """Runs of consecutive positions, ends exclusive."""
    out: list[list[int]] = []
    for p in positions:
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return [tuple(x) for x in out]


def _merged(runs: Column) -> Column:
    """Runs that overlap or touch made one."""
    kind = "struct<out:array<struct<start:bigint,end:bigint>>,start:bigint,end:bigint>"

    def closed(acc: Column) -> Column:
        last = F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end")))
        return F.when(acc["start"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], last))

    def add(acc: Column, r: Column) -> Column:
        grown = F.struct(acc["out"].alias("out"), acc["start"].alias("start"), F.greatest(acc["end"], r["end"]).alias("end"))
        fresh = F.struct(closed(acc).alias("out"), r["start"].alias("start"), r["end"].alias("end"))
        return F.when(r["start"] <= acc["end"], grown).otherwise(fresh)

    none = F.struct(F.array().alias("out"), F.lit(None).alias("start"), F.lit(None).alias("end")).cast(kind)
    return F.aggregate(F.array_sort(runs), none, add, closed)


def pattern_blocks(benchmark: DataFrame, width: int, block_bytes: int, item_col: str, text_col: str) -> Iterator[dict[bytes, list[int]]]:
    """Dictionaries from windows to the items that have them, each of about ``block_bytes`` at most."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, windows = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new = sorted(windows_of(text, width))
                items += [item] * len(new)
                windows += new
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(windows, pa.binary())], ["item_id", "window"])

    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), text_bytes(text_col).alias("text"))
    windows = rows.mapInArrow(cut, "item_id long, window binary").distinct()
    block, held = {}, 0
    for item, window in windows.toLocalIterator():
        window = bytes(window)
        if window not in block and held + len(window) > block_bytes:
            yield block
            block, held = {}, 0
        if window not in block:
            block[window] = []
            held += len(window) + 64
        if item is not None:
            block[window].append(item)
    yield block


def find(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 16 << 20,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Per text: number of words, hit runs of words (``start``, ``end`` exclusive, in word positions), items found."""
    spark = ship(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    names = ["row", "doc_id", "n_words", "hits", "items"]
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def found(rows: DataFrame, patterns: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _built_once(patterns) if patterns.value else None
            for batch in batches:
                n_words, hits, items = [], [], []
                for text in batch.column(2).to_pylist():
                    words, hit, found = scan(automaton, text) if automaton else (words_of(text), (), ())
                    n_words.append(len(words))
                    hits.append([{"start": a, "end": b} for a, b in _spans(sorted(hit))])
                    items.append(sorted(found))
                columns = [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(hits, spans), pa.array(items, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names)

        return rows.mapInArrow(run, SCHEMA)

    blocks = pattern_blocks(benchmark, width, block_bytes, item_col, item_text_col)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return found(rows, spark.sparkContext.broadcast(first)).drop("row")

    # texts and their numbers are written, so that all scans agree on them; one block at a time is held anywhere
    rows, every = stored(rows, "numbered"), None
    for block in chain((first, second), blocks):
        patterns = spark.sparkContext.broadcast(block)
        part = stored(found(rows, patterns), "finds")
        patterns.destroy()
        every = part if every is None else every.union(part)
    by_text = every.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("hits").alias("hits"), F.collect_list("items").alias("items")
    )
    return by_text.select("doc_id", "n_words", _merged(F.flatten("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))


def clean(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 16 << 20,
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs``, all columns, without any hit; each block of patterns filters what the last one left."""
    spark, at = ship(docs.sparkSession), docs.columns.index(text_col)

    def without(rows: DataFrame, patterns: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _built_once(patterns)
            for batch in batches:
                free = [not scan(automaton, (text or "").encode())[1] for text in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(free, pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    blocks = pattern_blocks(benchmark, width, block_bytes, item_col, item_text_col)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return without(docs, spark.sparkContext.broadcast(first)) if first else docs
    for block in chain((first, second), blocks):
        patterns = spark.sparkContext.broadcast(block)
        docs = stored(without(docs, patterns), "clean")
        patterns.destroy()
    return docs


def original_spans(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point spans in ``text`` of hit runs of words, for showing or cutting out what was found."""
    raw = text.encode()
    at = [m.span() for m in WORDS.finditer(raw.translate(TO_WORDS))]
    return [(len(raw[: at[a][0]].decode()), len(raw[: at[b - 1][1]].decode())) for a, b in hits]
