"""Connected components of an undirected graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stored

#: Up to so many edges a node's least neighbour is sent to all workers (some 20 MB), beyond them it is shuffled.
FEW = 1 << 17


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """One contraction: every node's greater (or not greater) neighbours are linked with the least node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    met = both.join(F.broadcast(least), "u") if few else salted_join(both, least, ["u"], F.col("v"))
    out = met.where("v > u" if large else "v <> m").select("v", "m")
    if not large:
        out = out.union(least.select("u", "m"))
    out = out.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # a large star gives no more rows than it gets; without an exchange behind it they are made where they are read
    return out if few and large else out.distinct()


def _state(edges: DataFrame) -> tuple[int, bool]:
    """The number of edges, and whether they are stars around least nodes: no node has two above it or one on either side."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("up")), F.struct(F.col("v").alias("node"), F.lit(None).cast("long").alias("up")))
    by_node = edges.select(F.inline(ends)).groupBy("node").agg(F.count("up").alias("n"), F.min("up").alias("x"), F.max("up").alias("y"), F.max(F.col("up").isNull()).alias("down"))
    found = by_node.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if((F.col("x") < F.col("y")) | F.col("down") & F.col("x").isNotNull())).first()
    return found[0], found[1] == 0


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``component``, the least node it reaches, for every node of ``links`` (``a``, ``b``), a stored table."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    for i in range(most_rounds):
        n, settled = _state(edges)
        if settled:
            edges = edges if i else edges.distinct()
            break
        edges = stored(_star(_star(edges, True, n <= FEW), False, n <= FEW), "edges")
    else:
        raise RuntimeError("components have not settled")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
