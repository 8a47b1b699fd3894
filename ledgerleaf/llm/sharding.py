"""Sharding by histogram sort: shards are stretches of one order of all rows, cut so that their bytes are near equal.

A row's place in the order is a number of 63 bits: 40 from the hash of its text, so that equal texts lie together and a
cut tears one group of them at most, then 23 from the hash of id and text, so that even a group of copies that holds a
third of all rows can be cut. The bytes below
candidate boundaries are counted exactly over all partitions; each splitter's interval is probed again, 256 times finer,
until it meets the tolerance or lies next to a single row. Only then the rows are exchanged, once.

Only DataFrame functions. The driver sees at most 4096 counts in the first round and 256 for each splitter in later ones.

Defined cases: a null text has no bytes; rows equal in id and text share a place and are never cut apart; a table of
fewer rows than shards leaves shards empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored

BITS, TEXT, FIRST, NEXT = 63, 40, 12, 8
#: Rows are numbered within the cells of this many leading bits; a cell's offset is known from the counts. Cells of more
#: than this many rows, and than a 4096th of all, are cut into groups of equal texts, and each group into 64.
CELL_BITS, HEAVY, FINE_BITS = 18, 1024, TEXT + 6


def placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    by_text = F.shiftleft(F.shiftrightunsigned(F.xxhash64("text"), 64 - TEXT), BITS - TEXT)
    by_row = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - (BITS - TEXT))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    return rows.select("doc_id", "text", size.alias("size"), by_text.bitwiseOR(by_row).alias("place"))


def splitters(sizes: DataFrame, n: int, tolerance: float) -> list[int]:
    """Places of ``n - 1`` cuts of ``sizes`` (``place``, ``size``) into stretches of near equal size."""

    def probe(rows: DataFrame, width: int) -> list[tuple[int, int, int]]:
        cell = F.shiftright("place", width)
        return sorted((r.cell, r.size, r.n) for r in rows.groupBy(cell.alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect())

    width = BITS - FIRST
    counts = probe(sizes, width)
    total = sum(c[1] for c in counts)
    slack = tolerance * total / n
    found: dict[int, int] = {}
    open_cuts = {j: (total * j / n, 0, counts) for j in range(1, n)}
    while open_cuts:
        inside: dict[int, tuple[float, int, int]] = {}
        for j, (target, before, cells) in open_cuts.items():
            for cell, size, rows in cells:
                if before + size >= target:
                    break
                before += size
            else:
                found[j] = (1 << BITS) - 1
                continue
            low, high = target - before, before + size - target
            if min(low, high) <= slack or rows == 1 or width == 0:
                found[j] = (cell if low <= high else cell + 1) << width
            else:
                inside[j] = (target, before, cell)
        if inside:
            finer = max(0, width - NEXT)
            within = sizes.where(F.shiftright("place", width).isin(sorted({c for _, _, c in inside.values()})))
            by_cell: dict[int, list[tuple[int, int, int]]] = {}
            for c in probe(within, finer):
                by_cell.setdefault(c[0] >> (width - finer), []).append(c)
            open_cuts = {j: (target, before, by_cell[cell]) for j, (target, before, cell) in inside.items()}
            width = finer
        else:
            open_cuts = {}
    return [found[j] for j in range(1, n)]


def histogram_sort(
    docs: DataFrame, n_shards: int = 24, tolerance: float = 0.001, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All rows with ``size``, ``shard`` (0 to ``n_shards`` - 1) and ``slot``, their number within the shard from 0."""
    ship(docs.sparkSession)
    rows = placed(docs, id_col, text_col)
    sizes = stored(rows.select("place", "size"), "places")
    cuts = splitters(sizes, n_shards, tolerance)
    shard: Column = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("place") >= F.lit(cut)).cast("int")
    coarse = F.shiftright("place", BITS - CELL_BITS)
    least = max(HEAVY, sizes.count() // 4096)
    # fewer than 4096, as each has that share of the rows
    heavy = [r.cell for r in sizes.groupBy(coarse.alias("cell")).count().where(F.col("count") > least).collect()]
    cell = F.when(coarse.isin(heavy), F.shiftright("place", BITS - FINE_BITS)).otherwise(F.shiftleft(coarse, FINE_BITS - CELL_BITS))
    below = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = sizes.select(shard.alias("shard"), cell.alias("cell")).groupBy("shard", "cell").count()
    # about 2 ** CELL_BITS + n_shards rows of three numbers, and for each heavy cell 64 and its other rows
    offsets = F.broadcast(counts.select("shard", "cell", F.coalesce(F.sum("count").over(below), F.lit(0)).alias("offset")))
    dealt = rows.withColumns({"shard": shard, "cell": cell})
    inner = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("place", "doc_id"))
    numbered = dealt.withColumn("inner", inner).join(offsets, ["shard", "cell"])
    return numbered.select("doc_id", "text", "size", "shard", (F.col("offset") + F.col("inner") - 1).alias("slot"))
