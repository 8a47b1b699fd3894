"""N-gram Jaccard join with signature trees: exact links and their components.

Texts become sets of word shingles. Equal sets are one class, and classes are compared, not copies. A pair above the
threshold shares an element among the first few of both sets in any fixed order (prefix filter). The order here begins
with shingles of rare words and ends with shingles that many texts have; word and shingle counts cover all texts. Classes
with such an element in common, and sizes that may be linked at the element's place, directly or over others' sizes
between, meet in a cell; cells of the same members are one.

First each class is held against one leader, the class that leads most of its cells, then each component of several
classes so found against one class of another; these rounds have no more pairs than classes. Then cells of one least class
are one, and those of several components get signature trees: entries are bitmaps of the sets' elements; a node holds the OR of its children's bitmaps, the range
of their sizes and their component. Two trees, or one with itself, are traversed together from the roots: a pair of nodes
is left as soon as the bits that both have, and so the largest overlap below them, or their sizes, or their one component
allow no new link. Pairs of entries that may be linked are verified on the sets themselves, whose texts are read again. Of
two blocks with more such pairs than a few for each entry no pairs are written: the entries' sets come to their trees, which
verify while they are traversed, leave pairs that earlier links connect, and give a link less than components at most.

No cell becomes one task's burden and no group is expanded into all its pairs: the largest component of a cell is not
compared with itself, and cells are dealt block by block. Keys travel through cells, bitmaps only through those still open.

Defined cases: a null, empty or wordless text has an empty set, is linked with nothing and is its own component; equal
sets are linked; rows that repeat an id, or have none, are each a row of their own, and a component is named by its least
id, or by null if no row of it has one; an empty table gives no rows; other columns are ignored. Elements are 58-bit
hashes of shingles, classes 64-bit hashes of sets. Intermediate tables stay in the session's shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, salted_join, ship, stored, text_bytes
from .graphs import components
from .hashing import LOWER, StretchHasher, mixed, row_runs, word_borders, word_parts

#: A shingle of at least this many texts, and of a millionth of all, comes last in the order.
FREQUENT = 64
#: Words with a level of their own: those that make up this share of all words, and the least count of one.
WORD_SHARE, WORD_LEAST = 1 << 18, 16
#: Entries of a block, and children of a node of its tree.
BLOCK, FANOUT = 512, 8
#: Pairs that may be linked, for each entry that has one, up to which two blocks write pairs.
SPARSE = 2
#: Tables of at most so many rows of a few numbers (some 20 MB) are sent to all workers; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1 << 18
#: Items of a worker's count.
COUNTED = 1 << 21
U = np.uint64
HASH_BITS = 58


class WordHasher(StretchHasher):
    """64-bit hashes of the lower-cased words of many texts at once."""

    def runs(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For runs of rows of a binary column: first row, row behind the last, hashes of all words, words of each row."""
        for a, b, raw, edges in row_runs(column):
            hashes, at, counts = [], 0, np.zeros(b - a, dtype=np.int64)
            for part, borders in word_parts(raw, edges):
                starts, ends = word_borders(part, borders)
                hashes.append(self.of(LOWER[part], starts, ends))
                counts += np.diff(np.searchsorted(starts + at, edges))
                at += len(part)
            yield a, b, np.concatenate(hashes), counts


@dataclass
class Order:
    """Of shingles: what it takes to place one. Words' levels in a table by the first bits of their hashes (of two words
    in one place the more frequent has it), and shingles to come last, ascending, with a bitmap of their last bits."""

    words: np.ndarray
    levels: np.ndarray
    last: np.ndarray
    maybe: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, counts: np.ndarray, least: int, last: np.ndarray) -> Order:
        table, levels = np.zeros(1 << 20, dtype=U), np.zeros(1 << 20, dtype=np.uint8)
        by_count = np.lexsort((words, counts))
        place = (words[by_count] >> U(44)).astype(np.int64)
        table[place] = words[by_count]
        levels[place] = np.floor(np.log2(counts[by_count] / least)).astype(np.uint8) + 1
        maybe = np.zeros(1 << 22, dtype=bool)
        maybe[(last & U(len(maybe) - 1)).astype(np.int64)] = True
        return cls(table, levels, np.sort(last), maybe)

    def of_words(self, h: np.ndarray) -> np.ndarray:
        place = (h >> U(44)).astype(np.int64)
        return np.where(self.words[place] == h, self.levels[place], 0).astype(np.int64)

    def comes_last(self, shingles: np.ndarray) -> np.ndarray:
        out = self.maybe[(shingles & U(len(self.maybe) - 1)).astype(np.int64)] if len(self.last) else np.zeros(len(shingles), dtype=bool)
        if out.any():
            some = shingles[out]
            out[out] = self.last[np.minimum(np.searchsorted(self.last, some), len(self.last) - 1)] == some
        return out


def _windows(h: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles of texts one after another, where each begins among the words, and how many each text has.
    A text of fewer words is one shingle."""
    sizes = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    begin = np.cumsum(counts) - counts
    at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    padded = np.concatenate((h, np.zeros(width, dtype=U)))
    length = np.repeat(np.minimum(counts, width), sizes)
    out = length.astype(U)
    short = bool((length < width).any())
    for i in range(width):
        step = mixed(out * U(0x94D049BB133111EB) + padded[at + i])
        out = np.where(i < length, step, out) if short else step
    return out >> U(64 - HASH_BITS), at, sizes


def element_sets(h: np.ndarray, counts: np.ndarray, width: int, order: Order) -> Iterator[np.ndarray]:
    """Each text's set, ascending: an element's highest six bits are its shingle's place in the order."""
    hashes, at, sizes = _windows(h, counts, width)
    level = order.of_words(h)
    sums = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(level)))
    rarity = np.minimum(sums[np.minimum(at + width, len(h))] - sums[at], 62)
    rarity[order.comes_last(hashes)] = 63
    # windows of short texts reach into the next one
    for row in np.flatnonzero((counts > 0) & (counts < width)):
        one, begin = int(sizes[:row].sum()), int(counts[:row].sum())
        if rarity[one] != 63:
            rarity[one] = min(62, int(level[begin : begin + counts[row]].sum()))
    every = (rarity.astype(U) << U(HASH_BITS)) | hashes
    ends = np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        s = np.sort(every[a:b])
        if len(s) > 1:
            new = np.ones(len(s), dtype=bool)
            np.not_equal(s[1:], s[:-1], out=new[1:])
            s = s[new]
        yield s


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def bitmap_bits(n: int) -> int:
    """Four times the elements or more: about one bit in six is set."""
    return max(64, 1 << (4 * n - 1).bit_length())


def bitmap(s: np.ndarray) -> bytes:
    bits = np.zeros(bitmap_bits(len(s)), dtype=bool)
    bits[(s & U(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def tiled(b: np.ndarray, words: int) -> np.ndarray:
    """A bitmap repeated to ``words`` 64-bit words: a superset of what the wider bitmap of the same set holds."""
    return np.tile(b, words // len(b)) if len(b) < words else b


def folded(b: np.ndarray, words: int) -> np.ndarray:
    """A bitmap at fewer words: exactly the set's bitmap of that width."""
    return np.bitwise_or.reduce(b.reshape(-1, words), axis=0) if len(b) > words else b


class Node:
    """A node of a signature tree. ``bits``: the OR of the bitmaps below, at the width of the widest; ``excess``: the most
    elements by which a set below exceeds its bits; ``comp``: the one component below, or None. A leaf also has its
    entries' numbers and their bitmaps at the width of the narrowest."""

    __slots__ = ("bits", "children", "comp", "entries", "excess", "least", "most", "own", "sizes")


class SignatureTree:
    """Entries in the order of ``size``, then ``lead``, ``FANOUT`` children to a node."""

    def __init__(self, sizes: list[int], comps: list[int], leads: list[int], bitmaps: list[bytes], num: int, den: int):
        self.num, self.den = num, den
        own = [np.frombuffer(b, dtype=U) for b in bitmaps]
        # steps of size within which any two may be linked, then what is alike side by side
        step = [math.floor(math.log(n) / math.log(den / num)) if num < den else n for n in sizes]
        order = sorted(range(len(sizes)), key=lambda i: (step[i], leads[i], comps[i], i))
        level = []
        for a in range(0, len(order), FANOUT):
            part, leaf = order[a : a + FANOUT], Node()
            narrow, wide = min(len(own[i]) for i in part), max(len(own[i]) for i in part)
            leaf.children, leaf.entries, leaf.sizes = None, np.array(part), np.array([sizes[i] for i in part])
            leaf.own = np.stack([folded(own[i], narrow) for i in part])
            leaf.bits = np.bitwise_or.reduce([tiled(own[i], wide) for i in part])
            leaf.least, leaf.most = int(leaf.sizes.min()), int(leaf.sizes.max())
            leaf.excess = max(sizes[i] - int(np.bitwise_count(own[i]).sum()) for i in part)
            leaf.comp = comps[part[0]] if len({comps[i] for i in part}) == 1 else None
            level.append(leaf)
        while len(level) > 1:
            above = []
            for a in range(0, len(level), FANOUT):
                part, node = level[a : a + FANOUT], Node()
                wide = max(len(c.bits) for c in part)
                node.children = part
                node.bits = np.bitwise_or.reduce([tiled(c.bits, wide) for c in part])
                node.least, node.most = min(c.least for c in part), max(c.most for c in part)
                node.excess = max(c.excess for c in part)
                node.comp = part[0].comp if len({c.comp for c in part}) == 1 else None
                above.append(node)
            level = above
        self.root = level[0] if level else None

    def needed(self, a, b):
        """The least overlap with which sizes ``a`` and ``b`` can be linked: num / (num + den) of their sum."""
        return -(-(self.num * (a + b)) // (self.num + self.den))

    def apart(self, x: Node, y: Node) -> bool:
        """Whether no pair below the two nodes is a new link."""
        num, den = self.num, self.den
        if num * x.least > den * y.most or num * y.least > den * x.most or x.comp is not None and x.comp == y.comp:
            return True
        wide = max(len(x.bits), len(y.bits))
        shared = int(np.bitwise_count(tiled(x.bits, wide) & tiled(y.bits, wide)).sum()) + min(x.excess, y.excess)
        a, b = max(x.least, -(-num * y.least // den)), max(y.least, -(-num * x.least // den))
        return min(shared, x.most, y.most) < self.needed(a, b)

    def pairs(self, other: SignatureTree) -> Iterator[tuple[int, int]]:
        """Entries of this tree and of the other that may be linked; of one tree with itself each pair once."""
        if self.root is None or other.root is None:
            return
        left = [(self.root, other.root)]
        while left:
            x, y = left.pop()
            if x is not y and self.apart(x, y) or x is y and x.comp is not None:
                continue
            if x.children and y.children:
                left += [(c, d) for i, c in enumerate(x.children) for d in (x.children[i:] if x is y else y.children)]
            elif x.children:
                left += [(c, y) for c in x.children]
            elif y.children:
                left += [(x, d) for d in y.children]
            else:
                yield from self._of_leaves(x, y)

    def _of_leaves(self, x: Node, y: Node) -> Iterator[tuple[int, int]]:
        words = min(x.own.shape[1], y.own.shape[1])
        p = np.stack([folded(b, words) for b in x.own])[:, None, :]
        q = np.stack([folded(b, words) for b in y.own])[None, :, :]
        a, b = x.sizes[:, None], y.sizes[None, :]
        most = np.minimum(a - np.bitwise_count(p & ~q).sum(axis=2, dtype=np.int64), b - np.bitwise_count(q & ~p).sum(axis=2, dtype=np.int64))
        may = (most >= self.needed(a, b)) & (self.num * np.maximum(a, b) <= self.den * np.minimum(a, b))
        if x is y:
            may = np.triu(may, 1)
        for i, j in zip(*np.nonzero(may)):
            yield int(x.entries[i]), int(y.entries[j])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def _checked_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


def fitted_order(texts: DataFrame, width: int) -> Order:
    """The order of shingles. It covers all texts: a task reports words and shingles that it meets several times among
    some two million, so that counts are a little low; any order gives the same links, this one only makes cells small.

    The driver gets at most ``WORD_SHARE`` words and a million shingles, since each has that share of all or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()

        def report(parts: list[np.ndarray], kind: int) -> pa.RecordBatch:
            every = np.concatenate(parts) if parts else np.empty(0, dtype=U)
            found, n = np.unique(every, return_counts=True)
            often = n >= max(4, 8 * len(every) // COUNTED)
            keys, n = np.append(found[often].view(np.int64), 0), np.append(n[often], len(every))
            kinds = np.append(np.full(len(keys) - 1, kind), kind + 2).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(keys), pa.array(n, pa.int64())], ["kind", "key", "n"])

        held: tuple[list, list] = [], []
        for batch in batches:
            for _, _, h, counts in hasher.runs(batch.column(0)):
                for kind, found in enumerate((h, _windows(h, counts, width)[0])):
                    held[kind].append(found)
                    if sum(map(len, held[kind])) >= COUNTED:
                        yield report(held[kind], kind)
                        held[kind].clear()
        for kind in (0, 1):
            yield report(held[kind], kind)

    counts = texts.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = stored(counts, "counts")
    totals = {r.kind: r.n for r in counts.where("kind > 1").collect()}
    least = [max(WORD_LEAST, -(-totals.get(2, 0) // WORD_SHARE)), max(FREQUENT, -(-totals.get(3, 0) // 1_000_000))]
    words, last = (counts.where((F.col("kind") == k) & (F.col("n") >= least[k])).select("key", "n").toArrow() for k in (0, 1))

    def keys(found: pa.Table) -> np.ndarray:
        return found["key"].to_numpy().astype(np.int64).view(U)

    return Order.of(keys(words), words["n"].to_numpy().astype(np.int64), least[0], keys(last))


def signatures(texts: DataFrame, width: int, num: int, den: int, order) -> DataFrame:
    """``row`` and ``doc_id`` as they are, ``at`` (where the text is found again), ``n`` elements, ``cid`` (class, null for
    an empty set), ``keys`` (the set's first elements) and ``bitmap``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, names = WordHasher(), ["row", "doc_id", "at", "n", "cid", "keys", "bitmap"]
        for batch in batches:
            for a, b, h, counts in hasher.runs(batch.column(3)):
                sizes, cids, keys, lengths, bitmaps = [], [], [], [0], []
                for s in element_sets(h, counts, width, order.value):
                    n = len(s)
                    sizes.append(n)
                    first = n - -(-n * num // den) + 1 if n else 0
                    cids.append(class_of(s) if n else None)
                    keys.append(s[:first])
                    lengths.append(first)
                    bitmaps.append(bitmap(s) if n else b"")
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
                own = [batch.column(i).slice(a, b - a) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), pa.array(cids, pa.int64()), lists, pa.array(bitmaps, pa.binary())], names)

    schema = "row long, doc_id long, at long, n long, cid long, keys array<long>, bitmap binary"
    return texts.select("row", "doc_id", "at", "text").mapInArrow(run, schema)


PAIR = ["a", "b"]


def cell_members(classes: DataFrame, num: int, den: int) -> DataFrame:
    """``cid``, ``n``, ``hub`` and ``below`` (the least class of the cell with sizes as this
    one's, and of those before) and ``key``, the cell's least class, for every class of a cell.

    Classes with a first element in common are cut, in the order of their sizes, where none can be linked over the cut:
    a set whose element is at place i overlaps another, if it is their first in common, in n - i elements at most, which
    bounds the other's size too. Sizes go in steps of the factor that separates linked ones, so that a key has few rows
    in the windows.
    """
    most = F.floor(((F.col("n") - F.col("place")) * (num + den)) / num) - F.col("n")
    reach = F.greatest(F.least(F.floor(F.col("n") * den / num), most, F.lit((1 << 31) - 1)), F.lit(0)).cast("long")
    # a set's size and reach in one number; one exchange serves the counts and those whom they keep
    prefix = classes.select("cid", "n", F.posexplode("keys").alias("place", "key")).select("key", "cid", (F.shiftleft("n", 31) + reach).alias("both"))
    prefix = prefix.repartition(partitions(classes.sparkSession), "key")
    size_of, reach_of = lambda c: F.shiftright(c, 31), lambda c: F.col(c).bitwiseAND(F.lit((1 << 31) - 1))
    keys = prefix.groupBy("key").agg(F.count("cid").alias("size"), F.min("both").alias("least"), F.max("both").alias("most"))
    pair = (size_of("most") <= reach_of("least")) & (size_of("least") <= reach_of("most"))
    keys = keys.where((F.col("size") > 2) | (F.col("size") == 2) & pair).select("key")
    # all below stays with the key, in the tasks of that one exchange, but for telling apart what members cells have
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num) if num < den else F.col("n")).cast("int")
    near = prefix.join(keys.hint("shuffle_hash"), "key").select("key", "cid", size_of("both").alias("n"), reach_of("both").alias("reach"))
    near = near.withColumn("step", step)
    # a cell's members are told by their number and the sum of their hashes; of cells with the same members one is kept
    mark = F.sum(F.xxhash64("cid").cast("decimal(20,0)"))
    steps = near.groupBy("key", "step").agg(
        F.count("*").alias("size"), mark.alias("mark"), F.min("cid").alias("hub"), F.min("n").alias("least"), F.max("reach").alias("reach")
    )
    upward = Window.partitionBy("key").orderBy("step")
    so_far = F.max("reach").over(upward.rowsBetween(Window.unboundedPreceding, -1))
    steps = steps.withColumn("cut", F.coalesce(F.col("least") > so_far, F.lit(True)))
    steps = steps.withColumn("from", F.max(F.when(F.col("cut"), F.col("step"))).over(upward))
    steps = steps.withColumn("below", F.when(~F.col("cut"), F.lag("hub").over(upward))).select("key", "step", "from", "size", "mark", "hub", "below")
    cells = steps.groupBy("key", "from").agg(F.sum("size").alias("size"), F.sum("mark").alias("mark"), F.min("hub").alias("least_cid")).where("size > 1")
    cells = cells.groupBy("size", "mark", "least_cid").agg(F.min(F.struct("key", "from")).alias("at")).select(F.col("at.key").alias("key"), F.col("at.from").alias("_from"), "least_cid")
    chosen = steps.join(cells, "key").where(F.col("from") == F.col("_from")).select("key", F.col("step").alias("_step"), "least_cid", "hub", "below")
    return near.join(chosen, "key").where(F.col("step") == F.col("_step")).select(F.col("least_cid").alias("key"), "cid", "n", "hub", "below")


def leader_pairs(members: DataFrame) -> DataFrame:
    """Each class with the one that leads most of its cells: at most a pair for each class."""
    led = members.select("cid", F.explode(F.array("hub", "below")).alias("hub")).where("hub <> cid")
    often = led.groupBy("cid", "hub").agg(F.count("*").alias("k"))
    best = often.groupBy("cid").agg(F.max(F.struct("k", "hub")).alias("best"))
    return best.select(F.col("cid").alias("a"), F.col("best.hub").alias("b"))


def bridging_pairs(members: DataFrame) -> DataFrame:
    """Each component of several classes with a class of another such one, the cells' first or last, that it meets in most
    cells: at most a pair for each of these components."""
    several = members.where("several")
    ends = several.groupBy("key").agg(F.min(F.struct("comp", "cid")).alias("first"), F.max(F.struct("comp", "cid")).alias("last")).where("first.comp <> last.comp")
    other = F.when(F.col("comp") == F.col("first.comp"), F.col("last.cid")).otherwise(F.col("first.cid"))
    met = salted_join(several.select("key", "cid", "comp"), ends, ["key"], F.col("cid")).select("comp", "cid", other.alias("other"))
    often = met.groupBy("comp", "cid", "other").agg(F.count("*").alias("k"))
    best = often.groupBy("comp").agg(F.max(F.struct("k", "cid", "other")).alias("best"))
    return best.select(F.col("best.cid").alias("a"), F.col("best.other").alias("b"))


def open_members(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members of cells of several components, with ``comp`` and whether that has ``several`` classes."""
    with_comp = _checked_join(members, found.select(F.col("node").alias("cid"), "component"), ["cid"], "left")
    with_comp = with_comp.withColumns({"comp": F.coalesce("component", "cid"), "several": F.col("component").isNotNull()}).drop("component")
    with_comp = stored(with_comp, "members")
    cells = with_comp.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    return _checked_join(with_comp, stored(cells, "open"), ["key"])


TASK = ["key", "kind", "x", "y"]


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), *TASK).sortWithinPartitions(*TASK)


def _tree_pairs(entries: list[tuple], one: bool, num: int, den: int) -> Iterator[tuple[tuple, tuple]]:
    """Of the entries of two blocks (``left``, ``comp``, ``n``, ``lead``, ``bitmap``, more), or of ``one`` with itself, those
    of different components that may be linked."""
    sides = [[e for e in entries if e[0]], [e for e in entries if not e[0]]]
    trees = [SignatureTree([e[2] for e in s], [e[1] for e in s], [e[3] for e in s], [e[4] for e in s], num, den) for s in sides]
    for i, j in trees[0].pairs(trees[0] if one else trees[1]):
        p, q = sides[0][i], sides[0 if one else 1][j]
        if p[1] != q[1]:
            yield p, q


def remaining_pairs(members: DataFrame, bitmaps: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """All pairs of different components in a cell that may be linked, by signature trees, block by block; and for two
    blocks with many of them only the entries that have one (``TASK``, ``left``, ``cid``, ``comp``)."""
    by_comp = members.groupBy("key", "comp").agg(F.count("*").alias("k"))
    cells = by_comp.groupBy("key").agg(F.max(F.struct("k", "comp")).alias("major"), F.sum("k").alias("size"))
    cells = cells.select("key", F.col("major.comp").alias("major"), F.ceil(F.col("major.k") / BLOCK).alias("majors"), F.ceil((F.col("size") - F.col("major.k")) / BLOCK).alias("minors"))
    rows = salted_join(members, cells, ["key"], F.col("cid"))
    is_major, h = F.col("comp") == F.col("major"), F.xxhash64("cid")
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    own_minor, own_major = F.pmod(h, F.col("minors")), F.pmod(h, F.col("majors"))

    def task(kind: int, x: Column, y: Column, left: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), left.alias("left"))

    of_major = F.transform(upto("minors"), lambda i: task(1, i, own_major, F.lit(False)))
    with_major = F.transform(upto("majors"), lambda j: task(1, own_minor, j, F.lit(True)))
    with_minor = F.transform(upto("minors"), lambda j: task(0, F.least(own_minor, j), F.greatest(own_minor, j), own_minor <= j))
    tasks = F.when(is_major, of_major).otherwise(F.concat(with_major, with_minor))
    dealt = rows.select("key", "cid", "n", "comp", F.inline(tasks)).join(bitmaps.select("cid", "lead", "bitmap"), "cid")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for at, group in groupby(_rows(batches), key=lambda r: r[:4]):
            entries = [r[4:] for r in group]
            few, some = [], {}
            for p, q in _tree_pairs(entries, at[1] == 0 and at[2] == at[3], num, den):
                if len(few) <= SPARSE * len(entries):
                    few.append((p[5], q[5]))
                some[p[0], p[5]], some[q[0], q[5]] = p[1], q[1]
            if len(few) <= SPARSE * len(some):
                yield from ((p, q, *[None] * 6) for p, q in few)
            else:
                yield from ((cid, None, *at, left, comp) for (left, cid), comp in some.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(pairs(batches), [*PAIR, *TASK, "left", "comp"], [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 2 + [pa.bool_(), pa.int64()])

    found = _dealt(dealt).select(*TASK, "left", "comp", "n", "lead", "bitmap", "cid")
    found = stored(found.mapInArrow(run, "a long, b long, key long, kind int, x long, y long, left boolean, comp long"), "found")
    return found.where("key is null").select(*PAIR), found.where("key is not null").select(*TASK, "left", F.col("a").alias("cid"), "comp")


def verified_together(entries: DataFrame, texts: DataFrame, places: DataFrame, width: int, num: int, den: int, order) -> DataFrame:
    """Links among the entries of each two blocks (``TASK``, ``left``, ``cid``, ``comp``) that connect all components which
    any of their links connect. An entry's set travels once to each task."""
    ends = stored(entries.join(places, "cid"), "ends")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, kinds = WordHasher(), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for a, b, h, counts in hasher.runs(batch.column(0)):
                rows = zip(zip(*(batch.column(i).slice(a, b - a).to_pylist() for i in range(1, 8))), element_sets(h, counts, width, order.value))
                # a row that only seems to be the class's, by its hash, is left out
                found = ((*r, s.tobytes()) for r, s in rows if len(s) and class_of(s) == r[6])
                yield from _batches(found, [*TASK, "left", "comp", "cid", "data"], kinds, 512)

    sent = _checked_join(texts.select("at", "text"), ends, ["at"]).select("text", *TASK, "left", "comp", "cid")
    sent = sent.mapInArrow(sets, "key long, kind int, x long, y long, left boolean, comp long, cid long, data binary")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for at, group in groupby(_rows(batches), key=lambda r: r[:4]):
            own = {r[4:7]: np.frombuffer(r[7], dtype=U) for r in group}
            entries = [(left, comp, len(s), int(s[0]), bitmap(s), cid, s) for (left, comp, cid), s in own.items()]
            above: dict[int, int] = {}

            def root(c: int) -> int:
                while (up := above.get(c, c)) != c:
                    above[c] = c = above.get(up, up)
                return c

            for p, q in _tree_pairs(entries, at[1] == 0 and at[2] == at[3], num, den):
                if (u := root(p[1])) != (v := root(q[1])) and _overlap_links(p[2], p[6], q[2], q[6], num, den):
                    above[u] = v
                    yield p[5], q[5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(links(batches), PAIR, [pa.int64()] * 2)

    return _dealt(sent).select(*TASK, "left", "comp", "cid", "data").mapInArrow(run, "a long, b long")


def _overlap_links(a: int, p: np.ndarray, b: int, q: np.ndarray, num: int, den: int) -> bool:
    shared = a - int(np.setdiff1d(p, q, assume_unique=True).size)
    return den * shared >= num * (a + b - shared)


def bundled(pairs: DataFrame) -> DataFrame:
    """``cid`` of either end of each pair with where its data has to go: ``a`` and ``bundle``, of up to some hundred
    partners of one class, and ``b``, null for the first end, which goes once to each bundle."""
    # of classes with several bundles there is at most one for every BLOCK pairs
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("bundles")).where("bundles > 1")
    dealt = pairs.join(F.broadcast(counts), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("bundles", F.lit(1).cast("long"))).alias("bundle"))
    none = F.lit(None).cast("long").alias("b")
    return dealt.select(F.col("a").alias("cid"), "a", "bundle", none).distinct().union(dealt.select(F.col("b").alias("cid"), "a", "bundle", "b"))


def tested(sent: DataFrame, linked) -> DataFrame:
    """Pairs of ``sent`` (``a``, ``bundle``, ``b``, ``n``, ``data``) for which ``linked`` holds."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (a, _), group in groupby(_rows(batches), key=lambda r: r[:2]):
            x, before = None, None
            for _, _, b, n, raw in group:
                if b is None:
                    x = n, np.frombuffer(raw, dtype=U)
                elif b != before:
                    before = b
                    if linked(x, (n, np.frombuffer(raw, dtype=U))):
                        yield a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(links(batches), PAIR, [pa.int64()] * 2)

    n = partitions(sent.sparkSession)
    dealt = sent.select("a", "bundle", "b", "n", "data").repartition(n, "a", "bundle")
    return dealt.sortWithinPartitions("a", "bundle", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def likely(pairs: DataFrame, bitmaps: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs that may be linked by the bitmaps of both."""

    def linked(x: tuple[int, np.ndarray], y: tuple[int, np.ndarray]) -> bool:
        (a, p), (b, q) = x, y
        words = min(len(p), len(q))
        p, q = folded(p, words), folded(q, words)
        most = min(a - int(np.bitwise_count(p & ~q).sum()), b - int(np.bitwise_count(q & ~p).sum()))
        return most * (num + den) >= num * (a + b) and num * max(a, b) <= den * min(a, b)

    return tested(bundled(pairs).join(bitmaps, "cid").withColumnRenamed("bitmap", "data"), linked)


def verified(pairs: DataFrame, texts: DataFrame, places: DataFrame, width: int, num: int, den: int, order) -> DataFrame:
    """Those of the pairs whose sets have ``den * overlap >= num * union``. Texts are read again, and a set travels once
    for each bundle of partners, not once for each pair. ``places``: ``cid`` and ``at``."""
    ends = stored(bundled(pairs).join(places, "cid"), "ends")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for a, b, h, counts in hasher.runs(batch.column(0)):
                rows = zip(*(batch.column(i).slice(a, b - a).to_pylist() for i in range(1, 5)), element_sets(h, counts, width, order.value))
                # a row that only seems to be the class's, by its hash, is left out
                found = ((x, bundle, y, len(s), s.tobytes()) for cid, x, bundle, y, s in rows if len(s) and class_of(s) == cid)
                yield from _batches(found, ["a", "bundle", "b", "n", "data"], [pa.int64()] * 4 + [pa.binary()], 512)

    sent = _checked_join(texts.select("at", "text"), ends, ["at"]).select("text", "cid", "a", "bundle", "b")
    sent = sent.mapInArrow(sets, "a long, bundle long, b long, n long, data binary")

    def linked(x: tuple[int, np.ndarray], y: tuple[int, np.ndarray]) -> bool:
        return _overlap_links(*x, *y, num, den)

    return tested(sent, linked)


def linked_components(
    docs: DataFrame, width: int, num: int, den: int = 100, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id``, the least id that links of num/den or more reach, and
    ``first``, whether the row is the first of its component by id (null last) and ``row_col``, a number of each row's own;
    without it ``first`` is null."""
    spark: SparkSession = ship(docs.sparkSession)
    row = F.col(row_col).cast("long") if row_col else F.lit(None).cast("long")
    texts = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    texts = texts.withColumn("at", F.xxhash64("row", "doc_id", "text"))
    order = spark.sparkContext.broadcast(fitted_order(texts, width))
    rows = stored(signatures(texts, width, num, den, order), "signatures")
    # the first row by id, null last, then by number
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    same = [F.first(c).alias(c) for c in ("n", "keys")]
    classes = rows.where("cid is not null").groupBy("cid").agg(F.min("at").alias("at"), F.min(name).alias("name"), F.count("*").alias("copies"), *same)
    classes = stored(classes, "classes")
    members = stored(cell_members(classes, num, den), "members")
    places = stored(members.select("cid").distinct().join(classes.select("cid", "at"), "cid"), "places")
    # rows that are equal in all have one place and are one
    bitmaps = _checked_join(rows.select("cid", "at", "n", F.col("keys")[0].alias("lead"), "bitmap"), places, ["cid", "at"]).dropDuplicates(["cid"])
    bitmaps = stored(bitmaps.select("cid", "n", "lead", "bitmap"), "bitmaps")

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs")
        pairs = stored(likely(pairs, bitmaps, num, den), "likely")
        return stored(verified(pairs, texts, places, width, num, den, order), "links")

    links = checked(leader_pairs(members))
    # from here on a class is once in all cells of one least class
    members = stored(open_members(members.select("key", "cid", "n").distinct(), components(links)), "open-members")
    links = links.union(checked(bridging_pairs(members)))
    members = stored(open_members(members.drop("comp", "several"), components(links)), "open-members")
    pairs, together = remaining_pairs(members, bitmaps, num, den)
    links = links.union(checked(pairs)).union(stored(verified_together(together, texts, places, width, num, den, order), "links"))
    found = components(links).select(F.col("node").alias("cid"), "component")
    # only classes of several rows or with links have another component than their row's own id
    lookup = classes.select("cid", "name", "copies").join(found, "cid", "left").where("copies > 1 or component is not null")
    lookup = stored(lookup.select("cid", F.coalesce("component", "cid").alias("component"), "name"), "named")
    names = lookup.groupBy("component").agg(F.min("name").alias("name"))
    lookup = salted_join(lookup.select("cid", "component"), names, ["component"], F.col("cid")).select("cid", F.col("name.doc_id").alias("least"), F.col("name.row").alias("least_row"), F.lit(True).alias("several"))
    out = salted_join(rows.select("row", "doc_id", "n", "cid"), lookup, ["cid"], F.xxhash64("row", "doc_id"), how="left")
    several = F.coalesce("several", F.lit(False))
    return out.select(
        *([F.col("row").alias(row_col)] if row_col else []), "doc_id", F.col("n").alias("n_shingles"),
        F.when(several, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), (~several | (F.col("row") == F.col("least_row"))).alias("first"),
    )
