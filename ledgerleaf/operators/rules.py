"""Threshold rules: all candidates of all features in one pass, and the best of them, for one node or many at once."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fitness import Fitness, Side

#: Labels are classes of a classifier, not data: more of them are an error.
MOST_LABELS = 1000
#: Parts of each factor of two in which a field's values make one range, where no borders are given.
PARTS = 4
SIDES = ("le", "gt", "ex")


def labels_of(items: DataFrame, label: str) -> list[str]:
    found = items.select(F.col(label).cast("string").alias("y")).where("y is not null").distinct().limit(MOST_LABELS + 1).collect()
    if len(found) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    return sorted(r.y for r in found)


def unpivoted(items: DataFrame, keys: list[str], label: str, features: list[str]) -> DataFrame:
    """(keys, ``y``, ``field``, ``v``): one row for each feature of an item; ``v`` is null where it is missing."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in features])
    return items.select(*keys, F.col(label).cast("string").alias("y"), F.inline(pairs))


def borders_of(items: DataFrame, features: list[str], ranges: int = 64) -> dict[str, list[float]]:
    """For each field approximate quantiles: borders of ranges with about as many rows each, whatever its values are."""
    numbers = items.select(*[F.col(f).cast("double").alias(f) for f in features])
    found = numbers.stat.approxQuantile(features, [i / ranges for i in range(1, ranges)], 0.25 / ranges)
    return {f: sorted(set(q)) for f, q in zip(features, found)}


def _range_of(features: list[str], borders: dict[str, list[float]] | None) -> Column:
    """A whole number that is monotonous in ``v`` within a field; null where it is missing or NaN."""
    v = F.col("v")
    if borders is None:
        # ranges of equal ratio; zero lies between those of negative and of positive numbers
        step = F.floor(F.log2(F.abs(v)) * PARTS) + 1100 * PARTS
        out = F.when(v == 0, 0).when(v > 0, step).otherwise(-step)
    else:
        out = F.lit(None)
        for f in features:
            below = F.array_position(F.array_sort(F.array_append(F.array(*[F.lit(float(b)) for b in borders[f]]).cast("array<double>"), v)), v)
            out = F.when(F.col("field") == f, below).otherwise(out)
    return F.when(v.isNotNull() & ~F.isnan(v), out).cast("long")


def columns(labels: list[str]) -> tuple[list[str], list[str], list[str]]:
    """Names of a candidate's counts by label: at or below the threshold, above it, and of rows without a value."""
    return tuple([f"{side}_{i}" for i in range(len(labels))] for side in ("le", "gt", "ex"))


@lru_cache(64)
def _sums(of_field: tuple[str, ...], n: int) -> tuple[dict[str, Column], dict[str, Column]]:
    """Of ``n`` labels' counts the sums over a field and over the ranges before one, and the running ones within a range.
    They are the same at every level of a tree, whose levels would otherwise build them anew."""
    every = Window.partitionBy(*of_field)
    # NaN, whose range is null too, is below all others
    before = every.orderBy(F.col("_missing").desc(), F.col("_range").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sums, there, missing = {}, "sum(if(_missing, 0, c{i}))", "sum(if(_missing, c{i}, 0))"
    for i in range(n):
        sums[f"ex_{i}"] = F.expr(missing.format(i=i)).over(every)
        sums[f"_n_c{i}"] = F.expr(there.format(i=i)).over(every)
        sums[f"_b_c{i}"] = F.coalesce(F.expr(there.format(i=i)).over(before), F.lit(0))
    upto = Window.partitionBy(*of_field, "_range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return sums, {f"_r_c{i}": F.sum(f"c{i}").over(upto) for i in range(n)}


@lru_cache(64)
def _fitness_columns(fitness: Fitness, n: int) -> tuple[dict[str, Column], Column]:
    """Sums and numbers of labels of each side, and the fitness over them, for ``n`` labels."""
    names = {s: [f"{s}_{i}" for i in range(n)] for s in SIDES}
    listed = {"le": [f"{c} > 0" for c in names["le"]], "gt": [f"{a} + {b} > 0" for a, b in zip(names["le"], names["gt"])], "ex": [f"{c} > 0" for c in names["ex"]]}
    sums = {f"n_{s}": F.expr(" + ".join(["0L", *names[s]])) for s in SIDES} | {f"_k_{s}": F.expr(" + ".join(["0", *[f"int({x})" for x in listed[s]]])) for s in SIDES}
    sides = [Side([F.col(c).cast("double") for c in names[s]], F.col(f"n_{s}").cast("double"), F.col(f"_k_{s}")) for s in SIDES]
    return sums, F.nanvl(fitness(*sides), F.lit(None).cast("double"))


def candidates(
    items: DataFrame, label: str, features: list[str], keys: list[str] = (), labels: list[str] | None = None, borders: dict[str, list[float]] | None = None
) -> DataFrame:
    """(keys, ``field``, ``threshold``, counts): counts by label on each side of every distinct value of a field, in the
    columns that ``columns`` names. Fields of fewer than two labels have no candidates. NaN is above no threshold and is none.

    Items are counted by value first; running sums see a row for each distinct value. Values of a field are cut into
    ranges, summed within them and carried over, so that a few features of very many values still make many tasks.
    """
    keys, labels = list(keys), labels_of(items, label) if labels is None else labels
    cs, (le, gt, ex) = [f"c{i}" for i in range(len(labels))], columns(labels)
    of_field = [*keys, "field"]
    counted = unpivoted(items, keys, label, features).groupBy(*of_field, "v").agg(*[F.count_if(F.col("y") == y).alias(c) for c, y in zip(cs, labels)])
    cut = counted.withColumns({"_range": _range_of(features, borders), "_missing": F.col("v").isNull()})
    by_range = cut.groupBy(*of_field, "_range", "_missing").agg(*[F.sum(c).alias(c) for c in cs])
    sums, inner = _sums(tuple(of_field), len(labels))
    carried = by_range.withColumns(sums).where("_range is not null").select(*of_field, "_range", *sums)
    inside = cut.where("_range is not null").withColumns(inner)
    same = [inside[k].eqNullSafe(carried[k]) for k in keys] + [inside["field"] == carried["field"], inside["_range"] == carried["_range"]]
    rows = inside.join(carried, same).select(*[inside[k] for k in of_field], "v", *[f"_r_{c}" for c in cs], *sums)
    below = [F.col(f"_r_{c}") + F.col(f"_b_{c}") for c in cs]
    sides = [n.alias(a) for n, a in zip(below, le)] + [(F.col(f"_n_{c}") - n).alias(a) for c, n, a in zip(cs, below, gt)]
    several = sum(((F.col(f"_n_{c}") > 0).cast("int") for c in cs), F.lit(0)) > 1
    return rows.where(several).select(*of_field, F.col("v").alias("threshold"), *sides, *ex)


def _columns_of(found: DataFrame, name: str) -> list[str]:
    return [c for c in found.columns if c.startswith(f"{name}_") and c[3:].isdigit()]


def side(found: DataFrame, name: str) -> Column:
    """The number of items on one side."""
    return sum((F.col(c) for c in _columns_of(found, name)), F.lit(0).cast("long"))


def with_fitness(found: DataFrame, fitness: Fitness) -> DataFrame:
    """Candidates with ``n_le``, ``n_gt``, ``n_ex`` and ``fitness``; a strategy is any function of the three sides.

    Sums come first, as columns of their own, so that the strategy's expression stays small however many labels there are.
    """
    sums, value = _fitness_columns(fitness, len(_columns_of(found, "le")))
    return found.withColumns(sums).withColumn("fitness", value).drop(*[f"_k_{s}" for s in SIDES])


def scored(found: DataFrame, fitness: Fitness) -> DataFrame:
    """Candidates with their fitness, those without one left out.

    A filter would carry the strategy's expression, with all that it is made of, down to the join below; a row for each
    fitness that is there leaves it where it is.
    """
    valued = with_fitness(found, fitness)
    there = F.explode(F.filter(F.array("fitness"), lambda f: f.isNotNull())).alias("fitness")
    return valued.select(*[c for c in valued.columns if c != "fitness"], there)


def best(found: DataFrame, keys: list[str] = (), fitness: Fitness | None = None) -> DataFrame:
    """The fittest rule (to 9 digits; ties by field, then threshold) for each combination of the keys. With ``fitness``
    the candidates needn't be scored before."""
    found = with_fitness(found, fitness) if fitness else found
    rank = F.struct((-F.round("fitness", 9)).alias("o"), "field", "threshold", "fitness", "n_le", "n_gt")
    ranked = found.select(*keys, F.when(F.col("fitness").isNotNull(), rank).alias("rank"))
    return ranked.groupBy(*keys).agg(F.min("rank").alias("r")).where("r is not null").select(*keys, "r.field", "r.threshold", "r.fitness", "r.n_le", "r.n_gt")


def admitted(rules: DataFrame, depth: Column, max_depth: int = 16, force_depth: int = 0, min_entropy: float = float("-inf")) -> DataFrame:
    """Rules that a strategy lets a node of this depth have."""
    return rules.where((depth < max_depth) & ((depth < force_depth) | (F.col("fitness") > min_entropy)))


def splittable(sizes: DataFrame, branch_threshold: int = 20) -> DataFrame:
    """Nodes with more items than the threshold."""
    return sizes.where(F.col("n") > branch_threshold)


def branch(value: Column, threshold: Column) -> Column:
    """0 pass (above), 1 fail (at or below, or NaN), 2 exception (missing)."""
    return F.when(value.isNull(), 2).when(~F.isnan(value) & (value > threshold), 0).otherwise(1)
