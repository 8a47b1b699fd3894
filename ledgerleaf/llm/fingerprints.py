"""Document fingerprints: Merkle trees over leaves, paragraphs and sections, with DataFrame functions only.

A paragraph is a line; its leaves are runs of words that end behind a word whose hash is divisible by 4, and words of more
than 64 signs are cut into such pieces; a section is a run of paragraphs that ends behind one whose hash is divisible by 4.
All borders come from the content, so that an insertion moves no later one. Each node hashes its children; the root is
equal for equal texts, and where two trees differ, their differing sections, paragraphs and leaves show the edit.

The fingerprint is the whole tree: ``root:section;section...`` with ``paragraph|paragraph...`` in a section and
``leaf,leaf,....node`` for a paragraph, its leaves' hashes of 32 bits and its own of 64. The likeness of two fingerprints
is 1 for equal roots; otherwise the trees are descended where sections differ, and it is 1 - (d + 1) / (a + b + 1) with d
the different leaves of such sections that the other tree's lack, and a and b the numbers of different leaves.

Defined cases: a null text is the empty one, whose tree has one empty paragraph; a null id counts as -2 ** 63 and is given
back as null, and so is that id; rows that repeat an id have the same next document, and where the next id repeats, its row
of the least text is taken; a table of one document has itself as the next; an empty table gives no rows; other columns are
ignored. The table of ids stays in the session's shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, ship, stored, whole_text

#: Borders of leaves and sections: one in so many.
LEAF, SECTION = 4, 4
#: A word, or a piece of a long one, with the spaces behind it.
UNIT = r"\S{1,64}+\s*+|\s++"
#: Stands for a null id, so that such rows take part in joins.
NO_ID = -(1 << 63)
NODES = ["root", "sections", "n_leaves"]


def leaves(text: Column) -> Column:
    """An array of leaf hashes for each paragraph."""

    def of(paragraph: Column) -> Column:
        units = F.regexp_extract_all(paragraph, F.lit(UNIT), F.lit(0))
        marked = F.transform(units, lambda u: F.when(F.pmod(F.xxhash64(u), F.lit(LEAF)) == 0, F.concat(u, F.lit("\u0001"))).otherwise(u))
        runs = F.filter(F.split(F.array_join(marked, ""), "\u0001", -1), lambda r: r != "")
        return F.transform(runs, lambda r: F.xxhash64(r))

    return F.transform(F.split(text, "\n", -1), of)


def _digits(hash_: Column) -> Column:
    return F.lpad(F.lower(F.hex(hash_)), 16, "0")


def with_tree(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """``df`` with ``root``, ``sections`` (each with its paragraphs and leaves) and ``n_leaves`` of the text's tree."""
    at = prefix + "leaves"
    df = df.withColumn(at, leaves(F.col(text)))

    def paragraph(hashes: Column) -> Column:
        node = F.xxhash64(hashes)
        end = F.when(F.pmod(node, F.lit(SECTION)) == 0, ";").otherwise("|")
        return F.concat(F.array_join(F.transform(hashes, lambda h: F.concat(F.substring(_digits(h), 1, 8), F.lit(","))), ""), F.lit("."), _digits(node), end)

    n = F.size(F.array_distinct(F.transform(F.flatten(at), lambda h: F.shiftright(h, 32).cast("int"))))
    df = df.withColumns({prefix + "sections": F.split(F.array_join(F.transform(at, paragraph), ""), ";", -1), prefix + "n_leaves": n})
    return df.withColumn(prefix + "root", F.sha2(F.array_join(prefix + "sections", ";"), 256)).drop(at)


def fingerprint(prefix: str = "") -> Column:
    return F.concat_ws(":", F.col(prefix + "root"), F.array_join(prefix + "sections", ";"))


def differing(a: str, b: str, level: str = "sections") -> Column:
    """Nodes of the first tree that the second lacks, at ``sections``, ``paragraphs`` or ``leaves``: where an edit lies."""
    sections = F.array_except(a + "sections", b + "sections")
    if level == "sections":
        return sections
    others = F.array_except(b + "sections", a + "sections")
    if level == "paragraphs":
        return F.array_except(_paragraphs(sections), _paragraphs(others))
    return F.array_except(_leaves(sections), _leaves(others))


def _paragraphs(sections: Column) -> Column:
    return F.filter(F.split(F.array_join(sections, "|"), "[|]"), lambda p: p != "")


def _leaves(sections: Column) -> Column:
    bare = F.regexp_replace(F.array_join(sections, ","), "[.][0-9a-f]{16}[|]?", "")
    return F.filter(F.split(bare, ","), lambda h: h != "")


def differing_lines(a: str, b: str) -> Column:
    """Numbers, from 0, of the first tree's paragraphs that the second's differing sections lack."""
    lacking = differing(a, b, "paragraphs")
    numbered = F.transform(_paragraphs(F.col(a + "sections")), lambda p, i: F.when(F.array_contains(lacking, p), i))
    return F.when(F.size(lacking) > 0, F.array_compact(numbered)).otherwise(F.array().cast("array<int>"))


def likeness(a: str, b: str) -> Column:
    """Of the fingerprints whose columns begin with ``a`` and ``b``: from 0 to 1."""
    different = F.size(differing(a, b, "leaves")) + F.size(differing(b, a, "leaves"))
    n = F.col(a + "n_leaves") + F.col(b + "n_leaves")
    return F.when(F.col(a + "root") == F.col(b + "root"), F.lit(1.0)).otherwise(1 - (different + 1.0) / (n + 1))


def neighbours(docs: DataFrame, id_col: str) -> DataFrame:
    """``doc_id``, its ``n_chars`` (the most of its rows), and ``next_id`` in ascending order, the first after the last."""
    spark = docs.sparkSession
    ids = docs.groupBy("doc_id").agg(F.max(F.length("text")).cast("long").alias("n"))
    ranged = stored(ids.repartitionByRange(partitions(spark), "doc_id").withColumn("part", F.spark_partition_id()), "ids")
    # a row for each partition: the first id of the next one, of the first one after the last
    edges = ranged.groupBy("part").agg(F.min("doc_id").alias("first"))
    by_part = Window.orderBy("part")
    every = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select("part", F.coalesce(F.lead("first").over(by_part), F.first("first").over(every)).alias("beyond"))
    inside = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    joined = ranged.withColumn("inside", inside).join(F.broadcast(edges), "part")
    return joined.select("doc_id", "n", F.coalesce("inside", "beyond").alias("next_id"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` with the tree's columns; by itself the operator needs no shuffle."""
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), whole_text(text_col).alias("text"))
    return with_tree(rows, "text")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its tree, the tree of its edited text and the fingerprint of the next document.

    Texts move once: the exchange by id serves both the join that hands each document's beginning to the one before it
    and the join that receives it. Trees are built behind it, once for each of the two, as they are larger to move than
    to build.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), whole_text(text_col).alias("text"))
    pairs = neighbours(rows, "doc_id")
    taken = pairs.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("before"), F.floor(F.col("n") / 4).cast("int").alias("take"))
    handed = with_tree(rows.join(taken, "doc_id"), "text").select(
        F.col("before").alias("doc_id"), F.struct(F.substring(F.col("text"), F.lit(1), F.col("take")).alias("start"), *NODES).alias("next")
    )
    handed = handed.groupBy("doc_id").agg(F.min("next").alias("next"))
    joined = with_tree(rows.join(handed, "doc_id"), "text").select(
        "doc_id", "text", *NODES, F.col("next.start").alias("start"), *[F.col(f"next.{c}").alias(f"next_{c}") for c in NODES]
    )
    n = F.length("text")
    take = F.floor(n / 4).cast("int")
    edit = F.concat(F.substring(F.col("text"), F.lit(1), n - take), F.substring(F.col("start"), F.lit(1), take))
    with_edit = joined.withColumns({"n_chars": n.cast("long"), "edited_text": edit}).drop("start")
    return with_tree(with_edit, "edited_text", "edited_")
