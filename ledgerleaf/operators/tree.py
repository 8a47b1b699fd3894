"""Classification trees with three branches: level-wise growth, routing, ids, paths, walks, counts and predictions.

nodes(node_id, depth, field, threshold, fitness, is_leaf); members(items' columns, node_id). The root is 1, children of a
node are 3 (id - 1) + 2, + 3 and + 4 for pass, fail and exception.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fitness import Fitness, labeling_entropy
from ..sources.tables import ship, written
from . import rules, subtrees
from .ordered import global_rank

#: A ternary tree of this depth still has its ids within 63 bits.
MOST_DEPTH = 38
#: Down to this depth a level has at most 3 ** FEW_DEPTH rules, which every worker can hold.
FEW_DEPTH = 10


@dataclass(frozen=True)
class Strategy:
    """When nodes branch and what makes a rule fit; any function of three lists of counts by label will do."""

    fitness: Fitness = labeling_entropy(1.0)
    branch_threshold: int = 20
    max_depth: int = 16
    force_depth: int = 0
    min_entropy: float = float("-inf")

    @classmethod
    def never(cls) -> Strategy:
        return cls(max_depth=0)


def child(node: Column, bit: Column) -> Column:
    return (3 * (node - 1) + bit + 2).cast("long")


def _third(n: Column) -> Column:
    """Whole-number division by 3; ids of deep nodes have more digits than a double."""
    return F.call_function("div", n, F.lit(3)).cast("long")


def parent(node: Column) -> Column:
    return _third(node - 2) + 1


def bit(node: Column) -> Column:
    return F.pmod(node - 2, F.lit(3)).cast("int")


def path(node: Column) -> Column:
    """Bits from the root as an array."""
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(MOST_DEPTH)),
        F.struct(node.cast("long").alias("at"), F.array().cast("array<int>").alias("bits")),
        lambda a, _: F.when(a["at"] <= 1, a).otherwise(
            F.struct((_third(a["at"] - 2) + 1).alias("at"), F.concat(F.array(F.pmod(a["at"] - 2, F.lit(3)).cast("int")), a["bits"]).alias("bits"))
        ),
    )
    return steps["bits"]


def depth(node: Column) -> Column:
    return F.size(path(node))


def walk_key(node: Column) -> Column:
    """Sorts nodes pass, fail, exception, then their parent."""
    return F.concat(F.array_join(F.transform(path(node), lambda b: b.cast("string")), ""), F.lit("3"))


def by_path(bits: list[int]) -> int:
    node = 1
    for b in bits:
        node = 3 * (node - 1) + b + 2
    return node


def ancestors(node: Column) -> Column:
    """The node and all above it, root first."""
    start = F.struct(F.lit(1).cast("long").alias("at"), F.array(F.lit(1).cast("long")).alias("ids"))

    def step(a: Column, b: Column) -> Column:
        below = (3 * (a["at"] - 1) + b + 2).cast("long")
        return F.struct(below.alias("at"), F.concat(a["ids"], F.array(below)).alias("ids"))

    return F.aggregate(path(node), start, step)["ids"]


def value_of(field: Column, features: list[str]) -> Column:
    """The item's value of the field that a rule names."""
    out = F.lit(None).cast("double")
    for f in features:
        out = F.when(field == f, F.col(f).cast("double")).otherwise(out)
    return out


def grow(
    items: DataFrame, label: str, features: list[str], strategy: Strategy = Strategy(), node_col: str = "node_id", borders: dict[str, list[float]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Nodes and members of a tree over the items; two jobs for each level, over all its open nodes at once: one counts
    and chooses rules, one moves the items of those nodes that go on. Others are left where they are written.

    Nodes of few values (``subtrees.VALUES``) are not carried through levels: each is one group of a last job, which grows
    its subtree, if the strategy's fitness can be had from arrays.

    A node whose rule would leave a side empty stays a leaf. Only the root is split whatever its size. A rule's counts
    tell its children's sizes. ``borders``, as ``rules.borders_of`` gives them, deal fields of very many values evenly.
    """
    if strategy.max_depth > MOST_DEPTH:
        raise ValueError(f"deeper than {MOST_DEPTH}")
    labels = rules.labels_of(items, label)
    active = written(items.withColumn(node_col, F.lit(1).cast("long")))
    at_rest, levels, small = [], [], []
    sizes = written(active.groupBy(node_col).agg(F.count("*").alias("n")))
    fits = subtrees.VALUES // max(len(features), len(labels), 1) if hasattr(strategy.fitness, "counted") and labels else 0
    whole = sizes.first()
    apart = bool(whole and strategy.max_depth and whole.n <= fits)
    if apart:
        small.append(active.withColumn("_n", F.lit(whole.n)))
        active = active.limit(0)
    for level in range(0 if apart else strategy.max_depth):
        found = rules.best(rules.candidates(active, label, features, [node_col], labels, borders), [node_col], strategy.fitness)
        chosen = rules.admitted(found, F.lit(level), strategy.max_depth, strategy.force_depth, strategy.min_entropy)
        chosen = chosen.where("n_le > 0 and n_gt > 0").withColumn("depth", F.lit(level)).join(sizes, node_col)
        born = {0: F.col("n_gt"), 1: F.col("n_le"), 2: F.col("n") - F.col("n_gt") - F.col("n_le")}
        goes_on = F.array(*[born[b] > strategy.branch_threshold for b in born])
        chosen = written(chosen.withColumns({"born": F.array(*born.values()), "goes_on": goes_on, "large": F.array(*[born[b] > fits for b in born])}))
        counts = chosen.agg(F.count("*").alias("rules"), F.count_if(F.array_contains("goes_on", True)).alias("open"), F.count_if(F.exists(F.arrays_zip("goes_on", "large"), lambda b: b["goes_on"] & b["large"])).alias("large")).first()
        if not counts.rules:
            break
        levels.append(chosen)
        joined = _branched(active, chosen.select(node_col, "field", "threshold", "born", "goes_on", "large"), features, node_col)
        goes = F.coalesce(F.get("goes_on", F.col("_bit")), F.lit(False))
        to = F.when(~goes, 0).when(F.get("large", F.col("_bit")) | F.lit(level + 1 == strategy.max_depth), 1).otherwise(2)
        own = [c for c in active.columns if c != node_col]
        moved = joined.select(*own, F.col("_below").alias(node_col), F.get("born", F.col("_bit")).alias("_n"), to.alias("_to"))
        parts = written(moved, by="_to" if counts.open else None)
        at_rest.append(parts.where("_to = 0").drop("_to", "_n"))
        small.append(parts.where("_to = 2").drop("_to"))
        active = parts.where("_to = 1").drop("_to", "_n")
        sizes = chosen.select(F.posexplode("born").alias("b", "n"), node_col).select(child(F.col(node_col), F.col("b")).alias(node_col), "n")
        if not counts.large or level + 1 == strategy.max_depth:
            break
    if small and fits:
        below, ended = _small_subtrees(small, label, labels, features, strategy, node_col)
        at_rest.append(ended)
        if below.limit(1).count():
            levels.append(below)
    members = active
    for part in at_rest:
        members = members.unionByName(part)
    return _nodes(levels, written(members.groupBy(node_col).agg(F.count("*").alias("n"))) if not levels else None, items.sparkSession, node_col), members


def _small_subtrees(small: list[DataFrame], label: str, labels: list[str], features: list[str], strategy: Strategy, node_col: str) -> tuple[DataFrame, DataFrame]:
    """The rules below small nodes and the members there; a group holds one node's items."""
    items = small[0]
    for part in small[1:]:
        items = items.unionByName(part)
    ship(items.sparkSession)
    fields = [f for f in items.schema.fields if f.name != "_n"]
    names, strategy_, n_labels = sorted(features), strategy, len(labels)
    ready = items.withColumn("_y", F.coalesce(F.array_position(F.array(*[F.lit(y) for y in labels]), F.col(label).cast("string")), F.lit(0)) - 1)
    # numbers as rules see them, where a feature is of another type
    as_double = {f: f if items.schema[f].dataType.typeName() == "double" else f"_v{i}" for i, f in enumerate(names)}
    ready = ready.withColumns({c: F.col(f).cast("double") for f, c in as_double.items() if c != f})
    of_rule = [("_depth", pa.int32()), ("_field", pa.string()), ("_threshold", pa.float64()), ("_fitness", pa.float64())]

    def run(group: pa.Table) -> pa.Table:
        values = [group[as_double[f]] for f in names]
        x = np.column_stack([v.to_numpy().astype(np.float64) for v in values])
        missing = np.column_stack([v.is_null().to_numpy() for v in values])
        root, n = group[node_col][0].as_py(), group["_n"][0].as_py()
        found, ends = subtrees.subtree(root, n, x, missing, group["_y"].to_numpy(), names, n_labels, strategy_)
        kept = [pa.array(ends) if f.name == node_col else group[f.name] for f in fields]
        members = pa.table([*kept, pa.array([False] * len(ends)), *[pa.nulls(len(ends), k) for _, k in of_rule]], [*[f.name for f in fields], "_is_rule", *[c for c, _ in of_rule]])
        if not found:
            return members
        own = [pa.array([r[0] for r in found], pa.int64()) if f.name == node_col else pa.nulls(len(found), group[f.name].type) for f in fields]
        more = [pa.array([r[i] for r in found], k) for i, (_, k) in enumerate(of_rule, 1)]
        return pa.concat_tables([members, pa.table([*own, pa.array([True] * len(found)), *more], members.column_names)])

    schema = items.select(*[f.name for f in fields]).withColumns({"_is_rule": F.lit(None).cast("boolean"), **{c: F.lit(None).cast(k) for c, k in zip([c for c, _ in of_rule], ("int", "string", "double", "double"))}}).schema
    for f in schema.fields:
        f.nullable = True
    grown = written(ready.groupBy(node_col).applyInArrow(run, schema), by="_is_rule")
    found = grown.where("_is_rule").select(node_col, *[F.col(f"_{c}").alias(c) for c in ("depth", "field", "threshold", "fitness")])
    return found, grown.where("not _is_rule").select(*[f.name for f in fields])


def _nodes(levels: list[DataFrame], root: DataFrame | None, spark, node_col: str) -> DataFrame:
    """Inner nodes, and the children of these that have no rule: leaves, with or without members."""
    kinds = "node_id long, depth int, field string, threshold double, fitness double, is_leaf boolean"
    if root is not None:
        none = [F.lit(None).cast(k).alias(c) for c, k in (("field", "string"), ("threshold", "double"), ("fitness", "double"))]
        return written(root.select(F.lit(1).cast("long").alias("node_id"), F.lit(0).alias("depth"), *none, F.lit(True).alias("is_leaf")).where("node_id is not null"))
    levels = [level.select(F.col(node_col).alias("node_id"), "depth", "field", "threshold", "fitness", F.lit(False).alias("is_leaf")) for level in levels]
    inner = levels[0]
    for level in levels[1:]:
        inner = inner.unionByName(level)
    born = inner.select(F.explode(F.array(*[child(F.col("node_id"), F.lit(b)) for b in (0, 1, 2)])).alias("node_id"), (F.col("depth") + 1).alias("depth"))
    leaves = born.join(inner.select("node_id"), "node_id", "left_anti")
    return written(inner.unionByName(leaves.withColumn("is_leaf", F.lit(True)), allowMissingColumns=True).select(*[c.split()[0] for c in kinds.split(", ")]))


def _branched(members: DataFrame, chosen: DataFrame, features: list[str], node_col: str) -> DataFrame:
    """``members`` with their node's rule, ``_bit``, the branch that it gives, and ``_below``, the node they come to."""
    # a rule for each open node of a level: whether they are sent to all workers is left to their size
    joined = members.join(chosen, node_col, "left")
    joined = joined.withColumn("_bit", F.when(F.col("field").isNotNull(), rules.branch(value_of(F.col("field"), features), F.col("threshold"))).cast("int"))
    return joined.withColumn("_below", F.when(F.col("_bit").isNull(), F.col(node_col)).otherwise(child(F.col(node_col), F.col("_bit"))))


def _routed_once(members: DataFrame, chosen: DataFrame, features: list[str], node_col: str) -> DataFrame:
    columns = members.columns
    joined = _branched(members, chosen.select(node_col, "field", "threshold"), features, node_col)
    return joined.drop(node_col).withColumnRenamed("_below", node_col).select(*columns)


def routed(items: DataFrame, nodes: DataFrame, features: list[str], node_col: str = "node_id") -> DataFrame:
    """Items with the deepest node whose rules lead to them; they stay in the tasks that read them, rules are sent there."""
    # written, as Spark deals all items by their few nodes where it does not know how small the other side is
    inner = written(nodes.where("not is_leaf").select("node_id", "depth", "field", "threshold"))
    deepest = inner.agg(F.max("depth")).first()[0]
    out = items.withColumn(node_col, F.lit(1).cast("long"))
    for level in range(0 if deepest is None else deepest + 1):
        rule = inner.where(F.col("depth") == level).select(F.col("node_id").alias(node_col), "field", "threshold")
        out = _routed_once(out, F.broadcast(rule) if level <= FEW_DEPTH else rule, features, node_col)
    return out


def path_of(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each wanted node's chain to the root with the rules on it: (``node_id``, ``ancestor``, ``rule``)."""
    chain = wanted.select("node_id", F.explode(ancestors(F.col("node_id"))).alias("ancestor"))
    rule = F.concat_ws(" > ", "field", F.col("threshold").cast("string"))
    named = nodes.select(F.col("node_id").alias("ancestor"), F.when(~F.col("is_leaf"), rule).alias("rule"))
    return chain.join(named, "ancestor").select("node_id", "ancestor", "rule")


def subtree_counts(members: DataFrame, label: str, node_col: str = "node_id") -> DataFrame:
    """Label histograms of every node over all below it; members are counted by leaf before they meet their ancestors."""
    leaves = members.groupBy(node_col, F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))
    return leaves.select(F.explode(ancestors(F.col(node_col))).alias("node_id"), "label", "n").groupBy("node_id", "label").agg(F.sum("n").alias("n"))


def label_histogram(members: DataFrame, label: str, labels: list[str]) -> DataFrame:
    """``node_id`` and ``n_<label>`` for every node that has items below it."""
    counted = subtree_counts(members, label)
    return counted.groupBy("node_id").agg(*[F.coalesce(F.sum(F.when(F.col("label") == y, F.col("n"))), F.lit(0)).alias(f"n_{y}") for y in labels])


def found(items: DataFrame, nodes: DataFrame, members: DataFrame, label: str, labels: list[str], features: list[str]) -> DataFrame:
    """Each item with the node it comes to, the path there from the root, and the label counts of the members there."""
    here = routed(items, nodes, features)
    names = F.array_join(F.transform(path(F.col("node_id")), lambda b: b.cast("string")), "")
    # as in routing: of known size, and under plain names, as labels may differ by case alone
    counts = label_histogram(members, label, labels).withColumn("_path", names)
    counts = written(counts.toDF(*[f"c{i}" for i in range(len(counts.columns))])).toDF(*counts.columns)
    return here.join(counts, "node_id", "left").withColumn("path", F.coalesce("_path", names)).drop("_path")


def info(nodes: DataFrame, members: DataFrame, label: str, labels: list[str]) -> DataFrame:
    """Every node with its rule and the label counts of all below it; zeros where nothing is."""
    counts = nodes.join(label_histogram(members, label, labels), "node_id", "left")
    return counts.select("node_id", "depth", "field", "threshold", *[F.coalesce(f"n_{y}", F.lit(0)).alias(f"n_{y}") for y in labels])


def in_walk_order(members: DataFrame, ids: list[str], node_col: str = "node_id") -> DataFrame:
    """Members by node, pass before fail before exception before their parent, with their place from 1."""
    return global_rank(members.withColumn("walk_key", walk_key(F.col(node_col))), ["walk_key", *ids], "place")


def listed(members: DataFrame, ids: list[str], cursor: tuple | None, most: int, node_col: str = "node_id") -> DataFrame:
    """The next ``most`` members in walk order behind the cursor, the last page's last walk key and ids (None: from the
    first). A page is found by its key, not by counting."""
    keyed = members.withColumn("walk_key", walk_key(F.col(node_col)))
    place = F.struct("walk_key", *ids)
    if cursor is not None:
        keyed = keyed.where(place > F.struct(*[F.lit(v).alias(c) for v, c in zip(cursor, ["walk_key", *ids])]))
    return keyed.orderBy("walk_key", *ids).limit(most)


def predictions(members: DataFrame, label: str, node_col: str = "node_id") -> DataFrame:
    """The most frequent label of each leaf; ties by label."""
    leaves = members.groupBy(node_col, F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))
    return leaves.groupBy(node_col).agg(F.max_by("label", F.struct("n", "label")).alias("predicted"))


def accuracy(items: DataFrame, nodes: DataFrame, members: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Share of items whose leaf's most frequent label is theirs."""
    hit = F.col(label).cast("string") == F.col("predicted")
    # as in routing: of known size
    found = routed(items, nodes, features).join(written(predictions(members, label)), "node_id", "left")
    return found.agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("accuracy"))
