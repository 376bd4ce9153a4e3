"""Boosted trees for the search of a grid: one fit a task, on all rows.

A round of boosting on a cluster is a job per level of a tree, which costs more than the work itself where one task can hold the rows. A search has
thousands of rounds on the same rows, so there each fit is one task and fits run side by side. The rules are those of
``pyspark.ml.classification.GBTClassifier``: log loss on labels -1 and 1, the first tree on the labels, later ones on the loss's gradient, variance as impurity,
``bins`` bins a feature. Rows of weight 0 are led through the trees and change none, so the held-out fold is judged as the trees grow.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

LEAST_GAIN = 1e-9


def binned(x: np.ndarray, bins: int = 32) -> np.ndarray:
    """Bins of every feature: of about equal numbers of rows, or one a value where there are few."""
    out = np.zeros(x.shape, np.int64)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        if len(values) > bins:
            ordered = np.sort(x[:, f])
            at = np.arange(1, bins) * len(ordered) // bins
            cuts = np.unique((ordered[at - 1] + ordered[at]) / 2)
        else:
            cuts = (values[1:] + values[:-1]) / 2
        out[:, f] = np.searchsorted(cuts, x[:, f], "left")
    return out


def tree(cells: np.ndarray, target: np.ndarray, weight: np.ndarray, depth: int, bins: int) -> np.ndarray:
    """What a regression tree says of every row: the weighted mean of ``target`` in its leaf. Rows of weight 0 have no say.

    Sums are made feature by feature, so a level takes a few numbers a row besides ``cells``, which are best a byte each and a feature's side by side.
    """
    n, width = cells.shape
    said, node, live = np.zeros(n), np.zeros(n, np.int64), np.arange(n)
    for level in range(depth + 1):
        # Nodes are numbered anew each level, so only those that hold rows take space.
        _, node = np.unique(node, return_inverse=True)
        nodes, w, wt = int(node.max(initial=-1)) + 1, weight[live], weight[live] * target[live]
        total, sums = np.bincount(node, w, nodes), np.bincount(node, wt, nodes)
        mean = np.divide(sums, total, out=np.zeros(nodes), where=total > 0)
        said[live] = np.where((total > 0)[node], mean[node], said[live])
        if level == depth:
            break
        learn = np.flatnonzero(w > 0)
        at, rows, own_w, own_s = node[learn] * bins, live[learn], w[learn], wt[learn]
        left_w, left_s = np.empty((nodes, width, bins)), np.empty((nodes, width, bins))
        for f in range(width):
            place = at + cells[rows, f]
            left_w[:, f] = np.bincount(place, own_w, nodes * bins).reshape(nodes, bins)
            left_s[:, f] = np.bincount(place, own_s, nodes * bins).reshape(nodes, bins)
        left_w, left_s = left_w.cumsum(2), left_s.cumsum(2)
        right_w, right_s = total[:, None, None] - left_w, sums[:, None, None] - left_s
        both = (left_w > LEAST_GAIN) & (right_w > LEAST_GAIN)
        gain = np.where(both, left_s**2 / np.where(both, left_w, 1) + right_s**2 / np.where(both, right_w, 1), -np.inf).reshape(nodes, -1)
        best = gain.argmax(1)
        worth = gain[np.arange(nodes), best] - np.divide(sums**2, total, out=np.zeros(nodes), where=total > 0) > LEAST_GAIN
        stay = worth[node]
        live, node = live[stay], node[stay]
        if not len(live):
            break
        node = 2 * node + (cells[live, best[node] // bins] > best[node] % bins)
    return said


def f1(truth: np.ndarray, says: np.ndarray) -> float:
    hit = float((truth & says).sum())
    return 2 * hit / max(1.0, float(truth.sum() + says.sum()))


def fold_figures(cells: np.ndarray, y: np.ndarray, weight: np.ndarray, held_out: np.ndarray, depth: int, rate: float, trees: Sequence[int], bins: int = 32) -> list[float]:
    """F1 on the held-out rows after as many rounds as each of ``trees`` says; a later round changes no earlier tree, so one fit has them all."""
    sign, w, margin, out = np.where(y, 1.0, -1.0), np.where(held_out, 0.0, weight), np.zeros(len(y)), {}
    for m in range(1, max(trees) + 1):
        target = sign if m == 1 else 4 * sign / (1 + np.exp(np.minimum(2 * sign * margin, 500)))
        margin += tree(cells, target, w, depth, bins) * (1.0 if m == 1 else rate)
        if m in trees:
            out[m] = f1(y[held_out], margin[held_out] > 0)
    return [out[n] for n in trees]
