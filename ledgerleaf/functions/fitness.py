"""Fitness of a threshold from label counts at or below it (``le``), above it (``gt``) and where the value is missing (``ex``).

Each function takes the three sides and is plain arithmetic over their columns. Labels that a side lacks have a zero
there. Of ``le`` and ``ex`` a zero doesn't count as a label of that side; of ``gt`` it does if ``le`` has the label. Null
stands for minus infinity: the rule is no candidate. A fitness with an attribute ``counted`` can be had from arrays too.
"""

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_SIDE = 0.15


@dataclass(frozen=True)
class Side:
    """Counts by label, their sum, and the number of labels."""

    counts: list[Column]
    total: Column
    labels: Column


Fitness = Callable[[Side, Side, Side], Column]


def total(counts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, counts, F.lit(0.0))


def labeling_entropy(smoothing: float = 1.0) -> Fitness:
    def part(side: Side) -> Column:
        # sum of c * ln((c + s) / whole), the logarithm of the whole taken once
        own = total([F.when(c > 0, c * F.log(c + smoothing)).otherwise(0.0) for c in side.counts])
        return own - F.when(side.total > 0, side.total * F.log(side.total + smoothing * side.labels)).otherwise(0.0)

    def fitness(le: Side, gt: Side, ex: Side) -> Column:
        full = le.total + gt.total + ex.total
        enough = (le.total > LEAST_SIDE * full) & (gt.total > LEAST_SIDE * full)
        return F.when(enough, (part(le) + part(gt) + part(ex)) / (full * math.log(2)))

    def counted(le: np.ndarray, gt: np.ndarray, ex: np.ndarray) -> np.ndarray:
        """The same for arrays of counts, a row for each label and a column for each candidate; NaN is none."""

        def part(counts: np.ndarray, labels: np.ndarray) -> np.ndarray:
            c, whole = counts.astype(np.float64), counts.sum(axis=0).astype(np.float64)
            own = np.zeros(c.shape[1])
            for of_label in c:
                own += np.where(of_label > 0, of_label * np.log(np.where(of_label > 0, of_label + smoothing, 1.0)), 0.0)
            return own - np.where(whole > 0, whole * np.log(np.where(whole > 0, whole + smoothing * labels, 1.0)), 0.0)

        below, above, without = (c.sum(axis=0).astype(np.float64) for c in (le, gt, ex))
        full = below + above + without
        value = (part(le, (le > 0).sum(axis=0)) + part(gt, (le + gt > 0).sum(axis=0)) + part(ex, (ex > 0).sum(axis=0))) / (full * math.log(2))
        return np.where((below > LEAST_SIDE * full) & (above > LEAST_SIDE * full), value, np.nan)

    fitness.counted = counted
    return fitness


def accuracy(le: Side, gt: Side, ex: Side) -> Column:
    both = le.total + gt.total
    hits = total([F.greatest(F.lit(0.0), F.lit(0.0), *side.counts) for side in (le, gt, ex)])
    enough = (le.total > LEAST_SIDE * both) & (gt.total > LEAST_SIDE * both)
    return F.when(enough, 1 - (both + ex.total - hits) / (both + ex.total))


def linear_entropy(smoothing: float = 1.0, weights: tuple[float, float, float] = (-0.1, 1.0, -1.0)) -> Fitness:
    """The linear mix ``w0 * self + w1 * ce1 + w2 * ce2`` over all labels of all sides.

    For a label's share x within all rows and the product y of its and the side's shares: ce1 sums x ln(s + y), ce2
    y ln(s + x) and self x ln(s + x), with s the smoothing over all rows.
    """
    if not any(weights):
        raise ValueError("all weights are zero")

    def term(t: Column) -> Column:
        x, y = t["count"] / t["n"], t["label"] * t["side"] / (t["n"] * t["n"])
        s = smoothing / t["n"]
        return weights[0] * x * F.log(s + x) + weights[1] * x * F.log(s + y) + weights[2] * y * F.log(s + x)

    def fitness(le: Side, gt: Side, ex: Side) -> Column:
        labels = [a + b + c for a, b, c in zip(le.counts, gt.counts, ex.counts)]
        n = le.total + gt.total + ex.total
        # one term's expression for all sides and labels: written out for each, it outgrows what can be compiled
        parts = [(count, label, side.total, n) for side in (le, gt, ex) for count, label in zip(side.counts, labels)]
        terms = F.array(*[F.struct(*[c.alias(k) for c, k in zip(part, ("count", "label", "side", "n"))]) for part in parts])
        # a label that the field lacks adds nothing
        out = F.aggregate(terms, F.lit(0.0), lambda sum_, t: sum_ + F.when(t["label"] > 0, term(t)).otherwise(0.0))
        return F.when((le.total > 0) & (gt.total > 0), out)

    return fitness
