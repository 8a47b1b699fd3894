"""Small nodes' whole subtrees, grown within the task that holds a node's items; the rules are those of ``rules``."""

from __future__ import annotations

import numpy as np

#: Values (items times features or labels) of a node whose subtree one task grows: some 32 MB.
VALUES = 1 << 22
#: Counts that are held at once while thresholds of one node are scored.
HELD = 1 << 21


def _best(x: np.ndarray, y: np.ndarray, kinds: np.ndarray, n_labels: int, fitness) -> tuple | None:
    """Fitness, number of the feature, threshold, items at or below and above it, of the fittest rule (to 9 digits; ties
    by feature, then threshold). ``kinds``: 0 for NaN, 1 for numbers, 2 where the value is missing; -1 is no label."""
    m, out, least = len(y), None, None
    wide = max(1, HELD // (m * n_labels))
    whole = np.bincount(y[y >= 0], minlength=n_labels)
    for a in range(0, x.shape[1], wide):
        v, k = x[:, a : a + wide], kinds[:, a : a + wide]
        order = np.argsort(v, axis=0, kind="stable") if (k == 1).all() else np.lexsort((v, k), axis=0)
        v, k = np.take_along_axis(v, order, 0), np.take_along_axis(k, order, 0)
        le = np.cumsum((y[order][:, :, None] == np.arange(n_labels)) & (k < 2)[:, :, None], axis=0)
        there = le[-1]
        last = k == 1
        last[:-1] &= (v[1:] != v[:-1]) | (k[1:] != 1)
        last &= ((there > 0).sum(axis=1) > 1)[None, :]
        f, i = np.nonzero(last.T)
        if not len(f):
            continue
        below = le[i, f]
        value = fitness(below.T, (there[f] - below).T, (whole - there[f]).T)
        rank = np.where(np.isnan(value), np.inf, -np.round(value, 9))
        at = int(np.argmin(rank))
        if not np.isnan(value[at]) and (least is None or rank[at] < least):
            least = rank[at]
            out = float(value[at]), a + int(f[at]), float(v[i[at], f[at]]), int(below[at].sum()), int((there[f[at]] - below[at]).sum())
    return out


def subtree(root: int, n: int, x: np.ndarray, missing: np.ndarray, y: np.ndarray, names: list[str], n_labels: int, strategy) -> tuple[list[tuple], np.ndarray]:
    """Rules (node, depth, field, threshold, fitness) of the subtree below ``root``, which has ``n`` items as its parent's
    rule counts them, and the node that each item comes to."""
    rules, nodes, depth, at = [], np.full(len(y), root, dtype=np.int64), 0, root
    while at > 1:
        at, depth = (at - 2) // 3 + 1, depth + 1
    kinds = np.where(missing, 2, np.where(np.isnan(x), 0, 1)).astype(np.int8)
    x = np.where(kinds == 1, x + 0.0, 0.0)
    left = [(root, depth, n, np.arange(len(y)))]
    while left:
        node, depth, n, rows = left.pop()
        if depth >= strategy.max_depth or not len(rows):
            continue
        found = _best(x[rows], y[rows], kinds[rows], n_labels, strategy.fitness.counted)
        if not found or not (depth < strategy.force_depth or found[0] > strategy.min_entropy) or not (found[3] and found[4]):
            continue
        value, field, threshold, n_le, n_gt = found
        rules.append((node, depth, names[field], threshold, value))
        k = kinds[rows, field]
        bit = np.where(k == 2, 2, np.where((k == 1) & (x[rows, field] > threshold), 0, 1))
        for b, born in enumerate((n_gt, n_le, n - n_gt - n_le)):
            child, own = 3 * (node - 1) + b + 2, rows[bit == b]
            nodes[own] = child
            if born > strategy.branch_threshold:
                left.append((child, depth + 1, born, own))
    return rules, nodes
