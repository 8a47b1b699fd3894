"""Language-model scores from a log-frequency Bloom filter.

Counts of words, of word n-grams, and of the byte n-grams that spell words, are quantised to levels of a logarithmic
scale, and an n-gram of level q is put into a Bloom filter q times, once with each level. Its count is read back by
probing levels until one is missing. A word's probability is its discounted count over all, plus the mass left by the
discount times the probability of its spelling under the byte n-grams, each order smoothed by the one below. Spellings
are learned from different words, once each: new words resemble rare ones. The discount follows from how many words occur
once and twice. A token's probability starts from that of the word and is smoothed upwards: with each longer context
before it (``word_orders`` words in all), an end token at the start of a text, the n-gram's count over the context's, plus
the shorter context's probability. A context that no training text has leaves the shorter one's probability.

The filter has ``PER_ENTRY`` bits for each entry, so that it grows with the corpus, and holds all n-grams from their first
level on. It is never in one place: ranges of it (for words at most ``most_bits`` bits, 32 MB, each) meet the keys that
ask for them in one task, and the answers go back to who asked. A word is modelled once, however many texts have it.

Texts are dealt once into pieces of some 4 MB. A piece reports its distinct words and n-grams, with the n-grams' counts in
its training texts, to ranges of keys, as differences of ascending keys; a range adds them up, builds its part of the
filter, probes it for every piece, and the piece's texts, from the same exchange, are scored with the answers. Words are
told apart by 64-bit hashes; keys of n-grams have 12 bits more than the number of tokens has, 48 at most.

Defined cases: a null or empty text is its end token alone; a null id counts as held out; without training texts all
counts are 0; repeated rows are counted and scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, ship, stored, text_bytes
from .hashing import LOWER, StretchHasher, row_runs, word_borders, word_parts

U = np.uint64
#: No word holds a space: this one stands for the end of a text.
END, END_KEY = b" end", U(0x3C6EF372FE94F82B)
#: Levels of counts grow by this factor; bits of a page and of an entry; probes of an entry.
BASE, PAGE, PER_ENTRY, PROBES = 1.5, 1 << 15, 12, 4
ORDERS = 6
SMOOTHING, ADDED = 2.0, 0.1
#: Bytes of the texts of a piece, and of those among which a word is reported once.
PIECE_BYTES, REPORT_BYTES = 4 << 20, 16 << 20
#: Words of a block, and keys of a row that asks for counts.
BLOCK_WORDS, ASKED, MESSAGE = 25_000, 512, 4096
#: Words of a range, and bytes of texts for each range of word n-grams.
RANGE_WORDS, RANGE_BYTES = 500_000, 8 << 20
SCHEMA = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def level_of(count: Column) -> Column:
    return (F.floor(F.log(count.cast("double") * (1 + 1e-12)) / math.log(BASE)) + 1).cast("int")


def typical_counts(most: int = 200) -> np.ndarray:
    """For each level the middle of the whole numbers that have it; 0 for level 0."""
    low = np.ceil(BASE ** np.arange(most) / (1 + 1e-9))
    high = np.ceil(BASE ** np.arange(1, most + 1) / (1 + 1e-9)) - 1
    return np.concatenate(([0.0], (low + np.maximum(low, high)) / 2))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def keys_of(hasher: StretchHasher, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keys of words; that of the end token is a number of its own."""
    keys = hasher.of(raw, starts, ends)
    for i in np.flatnonzero(raw[starts] == 0x20) if len(starts) else ():
        keys[i] = END_KEY
    return keys


def word_keys(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
    return keys_of(StretchHasher(), np.frombuffer(b"".join(words), dtype=np.uint8), np.append(0, ends[:-1]) if words else ends, ends)


def tokenized(column: pa.Array, hasher: StretchHasher) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows of UTF-8 bytes: first row, row behind the last, lower-cased bytes, where words start and end, their
    keys, and the number of each row's words."""
    for a, b, raw, edges in row_runs(column):
        at, found = 0, []
        for part, borders in word_parts(raw, edges):
            (starts, ends), low = word_borders(part, borders), LOWER[part]
            found.append((low, starts + at, ends + at, hasher.of(low, starts, ends)))
            at += len(part)
        low, starts, ends, keys = (np.concatenate(x) for x in zip(*found))
        yield a, b, low, starts, ends, keys, np.diff(np.searchsorted(starts, edges))


def gathered(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Stretches of bytes as a binary array."""
    lengths = ends - starts
    borders = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(lengths)))
    data = raw[np.repeat(starts - borders[:-1], lengths) + np.arange(borders[-1])]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(borders.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def spellings(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Over all predicted bytes of ``space + word + space``: the word's index, the number of bytes before (ORDERS - 1 at
    most), and for each order the keys of the n-gram and of its context."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    raw = np.frombuffer(b"".join([b" " + w for w in words]) + b" ", dtype=np.uint8).astype(U)
    at = np.arange(1, len(raw))
    word = np.repeat(np.arange(len(words)), lengths)
    before = np.minimum(at - 1 - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1, ORDERS - 1)
    code, grams = raw[at], []
    padded = np.concatenate((np.zeros(ORDERS, dtype=U), raw))
    for order in range(1, ORDERS + 1):
        if order > 1:
            code = code | (padded[at + ORDERS - (order - 1)] << U(8 * (order - 1)))
        grams.append(code)
    keys = [mixed(g + (U(order + 1) << U(56))) for order, g in enumerate(grams)]
    contexts = [np.zeros(len(at), dtype=U)]
    for order in range(1, ORDERS):
        contexts.append(mixed((grams[order] >> U(8)) + (U(order) << U(56))))
    return word, before, keys, contexts


class LogFilter:
    """The filter's bits, and the counts that probing gives."""

    def __init__(self, bits: np.ndarray, first_level: int):
        self.bits, self.pages, self.first = bits, len(bits) // (PAGE // 8), first_level
        self.counts = typical_counts()

    @staticmethod
    def spots(keys: np.ndarray, level: int | np.ndarray, probe: int) -> np.ndarray:
        """Bit within the page."""
        turn = np.atleast_1d(np.asarray(level, dtype=U)) * U(PROBES) + U(probe)
        return mixed(keys + turn * U(0x9E3779B97F4A7C15)) & U(PAGE - 1)

    def page(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) >> U(20)) % U(self.pages)

    def count(self, keys: np.ndarray, first: int = 1) -> np.ndarray:
        """Typical counts; 0 where already the ``first`` level is missing."""
        return self.counts[self.levels(keys, self.page(keys), first)]

    def levels(self, keys: np.ndarray, page: np.ndarray, first: int = 1) -> np.ndarray:
        """Levels of keys whose bits lie in the given pages of ``bits``."""
        levels = np.zeros(len(keys), dtype=np.int64)
        left, base = np.arange(len(keys)), page.astype(U) * U(PAGE)
        level = first
        while len(left) and level < len(self.counts):
            there = np.ones(len(left), dtype=bool)
            for probe in range(PROBES):
                spot = base[left] + self.spots(keys[left], level, probe)
                there &= (self.bits[(spot >> U(3)).astype(np.int64)] >> (spot & U(7)).astype(np.uint8)) & 1 == 1
            left = left[there]
            levels[left] = level
            level += 1
        return levels


class Answers:
    """Counts that the filter's ranges gave for ``keys``, ascending."""

    first = 1

    def __init__(self, keys: np.ndarray, levels: np.ndarray):
        self.keys, self.counts = keys, typical_counts()[levels]

    def count(self, keys: np.ndarray, first: int = 1) -> np.ndarray:
        return self.counts[np.searchsorted(self.keys, keys)]


class Scorer:
    """log10 probabilities of words under the filter."""

    def __init__(self, bits: np.ndarray | Answers, first_level: int, total: int, left_mass: float, discount: float = 0.5):
        self.filter = bits if isinstance(bits, Answers) else LogFilter(bits, first_level)
        self.total, self.left, self.discount = max(1, total), left_mass, discount

    def spelled(self, words: list[bytes]) -> np.ndarray:
        word, before, keys, contexts = spellings(words)
        p = np.full(len(word), 1 / 256)
        for order in range(ORDERS):
            use = np.flatnonzero(before >= order)
            grams, place = np.unique(keys[order][use], return_inverse=True)
            c = self.filter.count(grams)[place]
            if order:
                around, place = np.unique(contexts[order][use], return_inverse=True)
                n = np.maximum(self.filter.count(around)[place], c)
            else:
                n = np.full(len(use), float(self.filter_bytes))
                n = np.maximum(n, c)
            p[use] = (c + SMOOTHING * p[use]) / (n + SMOOTHING)
        return np.bincount(word, weights=np.log10(p), minlength=len(words))

    #: All predicted bytes, for order 1.
    filter_bytes = 1.0

    def log10(self, words: list[bytes]) -> np.ndarray:
        c = self.filter.count(word_keys(words), self.filter.first)
        own = np.maximum(c - self.discount, 0) / self.total
        return np.log10(own + self.left * 10 ** np.maximum(self.spelled(words), -300) + 1e-300)


def distinct_words(rows: DataFrame) -> DataFrame:
    """``word`` and ``n``, its count in training texts, once for each stretch of some 16 MB of a task's texts that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, names, ends_trained, ends_seen = StretchHasher(), ["word", "n"], 0, 0

        def report(held: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> Iterator[pa.RecordBatch]:
            keys, n, words = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), pa.concat_arrays([h[2] for h in held])
            _, first, place = np.unique(keys, return_index=True, return_inverse=True)
            counts, words = np.bincount(place, weights=n).astype(np.int64), words.take(pa.array(first))
            for a in range(0, len(first), 50_000):
                yield pa.RecordBatch.from_arrays([words.slice(a, 50_000), pa.array(counts[a : a + 50_000])], names)

        held, size = [], 0
        for batch in batches:
            held_out = np.array(batch.column(0).to_pylist(), dtype=bool)
            ends_trained, ends_seen = ends_trained + int((~held_out).sum()), ends_seen + len(held_out)
            for a, b, raw, starts, ends, keys, counts in tokenized(batch.column(1), hasher):
                if len(keys):
                    trained = np.repeat(~held_out[a:b], counts)
                    every, first, place = np.unique(keys, return_index=True, return_inverse=True)
                    held.append((every, np.bincount(place, weights=trained), gathered(raw, starts[first], ends[first])))
                size += len(raw)
                if size >= REPORT_BYTES and held:
                    yield from report(held)
                    held, size = [], 0
        if held:
            yield from report(held)
        if ends_seen:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends_trained], pa.int64())], names)

    return rows.select("held_out", "text").mapInArrow(run, "word binary, n long")


def byte_grams(words: DataFrame) -> DataFrame:
    """``key`` and ``n`` of the byte n-grams that spell ``word``, each counted ``n`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, dtype=U), np.empty(0)
        for batch in batches:
            found = batch.column(0).to_pylist()
            word, before, grams, _ = spellings(found)
            weight = batch.column(1).to_numpy()[word].astype(float)
            parts = [(keys, counts)] + [(grams[o][before >= o], weight[before >= o]) for o in range(ORDERS)]
            keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            counts = np.bincount(place, weights=np.concatenate([w for _, w in parts]), minlength=len(keys))
            if len(keys) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["key", "n"])
                keys, counts = np.empty(0, dtype=U), np.empty(0)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["key", "n"])

    return words.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def filter_pages(entries: DataFrame, n_pages: int) -> np.ndarray:
    """The pages of a small filter in one array."""
    out = np.zeros(n_pages * PAGE // 8, dtype=np.uint8)
    for page, bits in page_bits(entries, n_pages).collect():
        out[page * PAGE // 8 : (page + 1) * PAGE // 8] = np.frombuffer(bits, dtype=np.uint8)
    return out


def page_bits(entries: DataFrame, n_pages: int) -> DataFrame:
    """``page`` and ``bits`` of a filter of ``n_pages`` pages with ``entries`` (``key``, ``level``, ``first``: levels first
    to level); pages without entries are left out."""

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page = ((mixed(batch.column(0).to_numpy().view(U)) >> U(20)) % U(n_pages)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(page), *batch.columns], ["page", "key", "level", "first"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            page, key, level, first = (batch.column(i).to_numpy() for i in range(4))
            n = level - first + 1
            keys, pages = np.repeat(key.view(U), n), np.repeat(page, n)
            levels = np.arange(len(keys)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            spots = np.concatenate([LogFilter.spots(keys, levels, p) for p in range(PROBES)]).astype(np.int64)
            pages = np.tile(pages, PROBES)
            order = np.argsort(pages, kind="stable")
            cuts = np.flatnonzero(np.diff(pages[order], prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                bits.setdefault(int(pages[order[a]]), np.zeros(PAGE, dtype=bool))[spots[order[a:b]]] = True
        raw = [np.packbits(b, bitorder="little").tobytes() for b in bits.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int32()), pa.array(raw, pa.binary())], ["page", "bits"])

    spark = entries.sparkSession
    dealt = entries.mapInArrow(paged, "page int, key long, level int, first int").repartition(min(n_pages, partitions(spark)), "page")
    return dealt.mapInArrow(built, "page int, bits binary")


def asked_keys(words: list[bytes], n_pages: int, per_range: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, that the probabilities of ``words`` need, and the order that sorts them by range and key."""
    _, before, grams, contexts = spellings(words)
    every = [word_keys(words)] + [g[before >= o] for o, g in enumerate(grams)] + [c[before >= o] for o, c in enumerate(contexts) if o]
    keys = np.unique(np.concatenate(every))
    return keys, np.argsort(range_of(keys, n_pages, per_range), kind="stable")


def range_of(keys: np.ndarray, n_pages: int, per_range: int) -> np.ndarray:
    return ((mixed(keys) >> U(20)) % U(n_pages) // U(per_range)).astype(np.int32)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def modelled(words: DataFrame, n_words: int, entries: DataFrame, n_entries: int, most_bits: int, total: int, left: float, discount: float, n_bytes: int, n_ranges: int) -> DataFrame:
    """Messages to ranges of words: for every row of ``words`` (``word``, ``c``) its count and log10 probability.

    A range of pages and the keys that fall into it meet in one task; a block of words asks all ranges.
    """
    n = partitions(words.sparkSession)
    n_pages = max(1, -(-PER_ENTRY * n_entries // PAGE))
    per_range = max(1, min(most_bits // PAGE, -(-n_pages // (4 * n))))
    n_blocks = max(n, -(-n_words // BLOCK_WORDS))
    blocks = words.withColumn("block", F.pmod(F.xxhash64("word"), F.lit(n_blocks)).cast("int"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, group in groupby(_rows(batches), key=lambda r: r[0]):
            keys, order = asked_keys([w for _, w in group], n_pages, per_range)
            keys = keys[order]
            at_range = range_of(keys, n_pages, per_range)
            starts = np.flatnonzero(np.diff(at_range, prepend=-1))
            rows = [(int(at_range[a]), block, i, keys[i : min(i + ASKED, b)].tobytes()) for a, b in zip(starts, [*starts[1:], len(keys)]) for i in range(a, b, ASKED)]
            for i in range(0, len(rows), 2000):
                columns = zip(zip(*rows[i : i + 2000]), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], ["range", "block", "at", "data"])

    dealt = blocks.select("block", "word").repartition(n, "block").sortWithinPartitions("block")
    asked = dealt.mapInArrow(ask, "range int, block int, at int, data binary")
    pages = page_bits(entries, n_pages).select(F.floor(F.col("page") / per_range).cast("int").alias("range"), F.lit(-1).alias("block"), F.col("page").alias("at"), F.col("bits").alias("data"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at_range, group in groupby(_rows(batches), key=lambda r: r[0]):
            bits, held = np.zeros(per_range * PAGE // 8, dtype=np.uint8), []
            part = LogFilter(bits, 1)
            for _, block, at, data in group:
                if block < 0:
                    page = at - at_range * per_range
                    bits[page * PAGE // 8 : (page + 1) * PAGE // 8] = np.frombuffer(data, dtype=np.uint8)
                    continue
                held.append((block, at, data))
                if len(held) >= 1000:
                    yield answered(part, at_range, held)
                    held = []
            if held:
                yield answered(part, at_range, held)

    def answered(part: LogFilter, at_range: int, held: list[tuple]) -> pa.RecordBatch:
        keys = np.frombuffer(b"".join(data for _, _, data in held), dtype=U)
        page = (mixed(keys) >> U(20)) % U(n_pages) - U(at_range * per_range)
        levels, ends = part.levels(keys, page).astype(np.uint8).tobytes(), np.cumsum([len(data) // 8 for _, _, data in held]).tolist()
        rows = [(block, at, levels[a:b]) for (block, at, _), a, b in zip(held, [0, *ends], ends)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], ["block", "at", "data"])

    together = pages.union(asked).repartition(n, "range").sortWithinPartitions("range", "block")
    answers = together.mapInArrow(answer, "block int, at int, data binary")

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(_rows(batches), key=lambda r: r[0]):
            parts, listed, counts = [], [], []
            for _, at, data, c in group:
                if at >= 0:
                    parts.append(data)
                else:
                    listed.append(data)
                    counts.append(c)
            keys, order = asked_keys(listed, n_pages, per_range)
            levels = np.empty(len(keys), dtype=np.int64)
            levels[order] = np.frombuffer(b"".join(parts), dtype=np.uint8)
            scorer = Scorer(Answers(keys, levels), 1, total, left, discount)
            scorer.filter_bytes = n_bytes
            own, model, counts = word_keys(listed), scorer.log10(listed), np.array(counts, dtype=U)
            order = np.argsort(own)
            data = [(counts[order], packed), (model[order], lambda x: x.astype("<f4").tobytes())]
            yield from messages(own[order], key_range(own[order], 64, n_ranges), -1, data)

    own = blocks.select("block", F.lit(-1).alias("at"), F.col("word").alias("data"), "c")
    joined = own.union(answers.select("block", "at", "data", F.lit(None).cast("long").alias("c"))).repartition(n, "block").sortWithinPartitions("block", "at")
    return joined.mapInArrow(model, MESSAGES)


def word_grams(h: np.ndarray, starts: np.ndarray, orders: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order from 2 on the keys of the word n-grams of texts one after another (``h``: hashes of their tokens,
    ``starts``: where texts begin), and which tokens have one: an end token stands before each text."""
    at = np.arange(len(h)) - np.repeat(starts, np.diff(starts, append=len(h)))
    before = np.concatenate((word_keys([END]), h[:-1]))
    before[starts] = word_keys([END])[0]
    keys, has = [], []
    for order in range(2, orders + 1):
        # what the token before has as its n-gram of the order below is the context
        key = mixed(mixed(before + U(order)) + h)
        keys.append(key & ~U(0xFFFF))
        has.append(at >= order - 2)
        before = np.concatenate((key[:1], key[:-1]))
    return keys, has


MESSAGES = "at int, piece int, part int, n int, data binary"


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in as many bytes as the largest needs, all highest bytes together: what is alike packs well."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].T).tobytes()


def unpacked(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """The ``n`` numbers packed at ``at``, and where they end."""
    width = data[at]
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, 8 - width :] = np.frombuffer(data, np.uint8, width * n, at + 1).reshape(width, n).T
    return out.view(">u8").reshape(-1).astype(U), at + 1 + width * n


def unpacked_keys(data: bytes, n: int) -> tuple[np.ndarray, int]:
    steps, at = unpacked(data, 8, n)
    steps[0] = np.frombuffer(data, "<u8", 1)[0]
    return np.cumsum(steps, dtype=U), at


def messages(keys: np.ndarray, at_range: np.ndarray, piece: int, more: list) -> Iterator[pa.RecordBatch]:
    """Rows that take ascending keys, and what ``more`` has for each (values and how they become bytes), to their ranges."""
    starts, rows = np.flatnonzero(np.diff(at_range, prepend=-1)).tolist(), []
    for a, b in zip(starts, [*starts[1:], len(keys)]):
        for part, i in enumerate(range(a, b, MESSAGE)):
            j = min(i + MESSAGE, b)
            steps = np.diff(keys[i:j], prepend=keys[i])
            data = keys[i].astype("<u8").tobytes() + packed(steps) + b"".join(f(values[i:j]) for values, f in more)
            rows.append((int(at_range[a]), piece, part, j - i, data))
            if len(rows) >= 512:
                yield message_batch(rows)
                rows = []
    if rows:
        yield message_batch(rows)


def message_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in MESSAGES.split(", ")])


def key_range(keys: np.ndarray, bits: int, n_ranges: int) -> np.ndarray:
    """Ranges of ascending keys of so many bits."""
    high = keys >> U(bits - 24) if bits > 24 else keys << U(24 - bits)
    return ((high * U(n_ranges)) >> U(24)).astype(np.int32)


def tokens_of(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens of texts, an end token behind each text's words, and where texts start."""
    ends = np.cumsum(counts + 1) - 1
    out = np.empty(len(keys) + len(counts), dtype=U)
    is_word = np.ones(len(out), dtype=bool)
    is_word[ends] = False
    out[ends], out[is_word] = END_KEY, keys
    return out, ends - counts


def distinct_grams(keys: np.ndarray, starts: np.ndarray, orders: int, bits: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ascending keys of the tokens' distinct word n-grams from order 2 on, the place among them of each token's n-gram of
    each order, one order after another, and which tokens have one."""
    grams, has = word_grams(keys, starts, orders)
    every, place = np.unique(np.concatenate([k[x] for k, x in zip(grams, has)]) >> U(64 - bits), return_inverse=True)
    return every, place, has


class Ranges:
    """Where keys of words and of n-grams are counted: word ranges come first."""

    def __init__(self, words: int, grams: int, bits: int, orders: int):
        self.words, self.grams, self.bits, self.orders = words, grams, bits, orders

    def ask(self, piece: int, keys: np.ndarray, counts: np.ndarray, held_out: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A piece's messages."""
        tokens, starts = tokens_of(keys, counts)
        words = np.unique(tokens)
        yield from messages(words, key_range(words, 64, self.words), piece, [])
        if self.orders > 1:
            every, place, has = distinct_grams(tokens, starts, self.orders, self.bits)
            trained = np.repeat(~held_out, counts + 1)
            n = np.bincount(place, weights=np.concatenate([trained[x] for x in has]), minlength=len(every)).astype(U)
            yield from messages(every, key_range(every, self.bits, self.grams) + np.int32(self.words), piece, [(n, packed)])

    def answer(self, at: int, group: list[tuple]) -> Iterator[pa.RecordBatch]:
        """``group``: (piece, part, n, data) by piece; answers have a word's count and model, an n-gram's level."""
        if at < self.words:
            known = [unpacked_keys(data, n) + (n, data) for piece, _, n, data in group if piece < 0]
            parts = [(keys, *unpacked(data, to, n), n, data) for keys, to, n, data in known]
            keys = np.concatenate([p[0] for p in parts])
            counts = np.concatenate([p[1] for p in parts])
            model = np.concatenate([np.frombuffer(data, "<f4", n, to) for _, _, to, n, data in parts])
            order = np.argsort(keys)
            keys, counts, model = keys[order], counts[order], model[order]
            rows = []
            for piece, part, n, data in group:
                if piece >= 0:
                    asked = unpacked_keys(data, n)[0]
                    place = np.searchsorted(keys, asked)
                    if (keys[np.minimum(place, len(keys) - 1)] != asked).any():
                        raise ValueError("a word that no table has")
                    rows.append((at, piece, part, n, packed(counts[place]) + model[place].tobytes()))
                    if len(rows) >= 512:
                        yield message_batch(rows)
                        rows = []
        else:
            asked = [(piece, part, n, *unpacked_keys(data, n), data) for piece, part, n, data in group]
            counts = np.concatenate([unpacked(data, to, n)[0] for _, _, n, _, to, data in asked]).astype(np.float64)
            every, place = np.unique(np.concatenate([a[3] for a in asked]), return_inverse=True)
            c = np.bincount(place, weights=counts, minlength=len(every))
            seen = np.flatnonzero(c)
            levels = (np.floor(np.log(c[seen] * (1 + 1e-12)) / math.log(BASE)) + 1).astype(np.int64)
            own = filled(mixed(every[seen]), levels)
            keys = mixed(every)
            found = own.levels(keys, own.page(keys)).astype(np.uint8)[place].tobytes()
            ends = np.cumsum([a[2] for a in asked]).tolist()
            rows = [(at, piece, part, n, found[a:b]) for (piece, part, n, *_), a, b in zip(asked, [0, *ends], ends)]
            for i in range(0, len(rows) - 512, 512):
                yield message_batch(rows[i : i + 512])
            rows = rows[(len(rows) - 1) // 512 * 512 :]
        if rows:
            yield message_batch(rows)


def filled(keys: np.ndarray, levels: np.ndarray) -> LogFilter:
    """A filter of these keys, with levels 1 to the given one."""
    n_pages = max(1, -(-PER_ENTRY * int(levels.sum()) // PAGE))
    bits = np.zeros(n_pages * PAGE, dtype=bool)
    page = (mixed(keys) >> U(20)) % U(n_pages) * U(PAGE)
    for level in range(1, int(levels.max(initial=0)) + 1):
        there = levels >= level
        for probe in range(PROBES):
            bits[(page[there] + LogFilter.spots(keys[there], level, probe)).astype(np.int64)] = True
    return LogFilter(np.packbits(bits, bitorder="little"), 1)


def in_context(p: np.ndarray, exact: np.ndarray, starts: np.ndarray, end_count: float, counts: np.ndarray, has: list[np.ndarray]) -> np.ndarray:
    """log10 probabilities of tokens behind the words before them, from ``p``, their words' own; ``exact``: words' counts,
    ``counts``: their n-grams', one order after another."""
    n, done = np.concatenate(([end_count], exact[:-1])), 0
    n[starts] = end_count
    for x in has:
        c = np.zeros(len(p))
        c[x] = counts[done : done + int(x.sum())]
        done += int(x.sum())
        n = np.where(x, np.maximum(n, c), 0)
        # the more often a context is met, the more different words follow it
        lower = SMOOTHING * np.sqrt(np.maximum(n, 1))
        p = (c + lower * p) / (n + lower)
        n = np.concatenate(([0], c[:-1]))
    return np.log10(p)


def score(docs: DataFrame, held_out: Column, most_bits: int = 1 << 28, id_col: str = "doc_id", text_col: str = "text", word_orders: int = 1) -> DataFrame:
    """Counts and scores of every text; those where ``held_out``, a condition on ``doc_id``, is false are learned from."""
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).withColumn("held_out", F.coalesce(held_out, F.lit(True)))
    n = partitions(spark)

    words = stored(distinct_words(rows).groupBy("word").agg(F.sum("n").alias("c")), "words")
    known = words.where("c > 0")
    by_level = known.groupBy(level_of(F.col("c")).alias("level")).agg(F.count("*").alias("types"), F.sum("c").alias("tokens")).collect()
    total, types = sum(r.tokens for r in by_level), sum(r.types for r in by_level)
    once, twice = (sum(r.types for r in by_level if r.level == k) for k in (1, 2))
    discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
    n_words, size = words.agg(F.count("*"), F.sum((F.length("word") + 1) * F.col("c"))).first()
    # texts that are only held out count by their share
    size = (size or 0) * 10 // 9

    grams = stored(byte_grams(known.select("word", F.lit(1).cast("long").alias("n"))), "byte-grams")
    spelled = grams.agg(F.sum(level_of(F.col("n")).cast("long"))).first()[0] or 0

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = word_keys(batch.column(0).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(1)], ["key", "level"])

    by_word = known.select("word", level_of(F.col("c")).alias("level")).mapInArrow(keyed, "key long, level int")
    entries = by_word.union(grams.select("key", level_of(F.col("n")).alias("level"))).withColumn("first", F.lit(1))
    n_entries = spelled + sum(r.types * r.level for r in by_level)
    # what the discount leaves
    left = types * discount / total if total else 1.0
    ranges = Ranges(max(n, n_words // RANGE_WORDS), max(n, size // RANGE_BYTES), min(48, 12 + max(12, int(total).bit_length())), word_orders)
    found = modelled(words, n_words, entries, n_entries, most_bits, total, left, discount, grams_total(known), ranges.words)
    found = stored(found, "modelled")
    ends = words.where(F.col("word") == F.lit(END)).agg(F.sum("c")).first()[0] or 0
    smoothed = math.log10(total + ADDED * (types + 1))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, piece, held = StretchHasher(), None, []
        for batch in batches:
            pieces = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(pieces)) + 1).tolist(), len(pieces)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a and pieces[a] != piece:
                    if held:
                        yield from ranges.ask(piece, *(np.concatenate(x) for x in zip(*held)))
                    piece, held = int(pieces[a]), []
                held_out = np.array(batch.column(2).slice(a, b - a).to_pylist(), dtype=bool)
                for p, q, _, _, _, keys, counts in tokenized(batch.column(3).slice(a, b - a), hasher):
                    held.append((keys, counts, held_out[p:q]))
        if held:
            yield from ranges.ask(piece, *(np.concatenate(x) for x in zip(*held)))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, group in groupby(_rows(batches), key=lambda r: r[0]):
            yield from ranges.answer(at, [r[1:] for r in group])

    def scored(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.Table.from_batches([], schema=pa.schema([(x.split()[0], pa.float64() if "double" in x else pa.int64()) for x in SCHEMA.split(", ")]))
        texts, hasher = texts.combine_chunks(), StretchHasher()
        parts = [(keys, counts) for _, _, _, _, _, keys, counts in tokenized(texts["text"].chunk(0), hasher)]
        keys, lengths = (np.concatenate(x) for x in zip(*parts))
        tokens, starts = tokens_of(keys, lengths)
        own = sorted((r for r in zip(*(answers[c].to_pylist() for c in ("at", "part", "n", "data")))), key=lambda r: r[:2])
        of_words = [(*unpacked(data, 0, n), n, data) for at, _, n, data in own if at < ranges.words]
        exact = np.concatenate([c for c, _, _, _ in of_words]).astype(np.float64)
        model = np.concatenate([np.frombuffer(data, "<f4", n, to) for _, to, n, data in of_words]).astype(np.float64)
        every, place = np.unique(tokens, return_inverse=True)
        if len(every) != len(exact):
            raise ValueError("answers do not belong to these words")
        exact, scores = exact[place], model[place]
        if word_orders > 1:
            grams, place, has = distinct_grams(tokens, starts, word_orders, ranges.bits)
            levels = np.frombuffer(b"".join(data for at, _, _, data in own if at >= ranges.words), dtype=np.uint8)
            if len(levels) != len(grams):
                raise ValueError("answers do not belong to these n-grams")
            scores = in_context(10.0 ** np.maximum(scores, -300), exact, starts, float(ends), typical_counts()[levels[place]], has)
        base, seen, scores = (np.add.reduceat(t, starts) for t in (np.log10(exact + ADDED), (exact > 0).astype(np.int64), scores))
        n_tokens = lengths + 1
        columns = [texts["doc_id"].chunk(0), pa.array(n_tokens, pa.int64()), pa.array(seen, pa.int64()), pa.array(np.full(len(seen), total), pa.int64()), pa.array(base - n_tokens * smoothed), pa.array(scores)]
        return pa.Table.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    n_pieces = max(n, -(-size // PIECE_BYTES))
    piece = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_pieces)).cast("int")
    # one exchange of the texts serves those who ask and those who are answered
    dealt = rows.select(piece.alias("piece"), "doc_id", "held_out", "text").repartition(n, "piece")
    asked = dealt.sortWithinPartitions("piece").mapInArrow(ask, MESSAGES)
    together = found.union(asked).repartition(n, "at").sortWithinPartitions("at", "piece")
    answers = together.mapInArrow(answer, MESSAGES)
    return dealt.groupBy("piece").cogroup(answers.where("piece >= 0").groupBy("piece")).applyInArrow(scored, SCHEMA)


def grams_total(known: DataFrame) -> int:
    """Predicted bytes of all different training words: each word's, and the space behind it."""
    return known.agg(F.sum(F.length("word") + 1)).first()[0] or 1
