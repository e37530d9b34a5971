"""Exact regression trees on one property's days, and what many grid points can read from one fit.

A tree is grown level by level: the rows stand sorted by (node, value) in every feature, so running sums give the error
of every possible split of every node at once.  Splits do not depend on how deep the tree may get or how many rows a
node needs to be split, so a shallower tree, or one with a larger ``min_split``, is a cut of the deepest one; a
forest of 100 trees is the first half of one of 200, and boosting after 100 rounds is a stage of 200.  Called inside
grouped Spark tasks (``plans.grid``); a task has the days of one property.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

TIE = 1e-9


@dataclass
class Tree:
    feature: np.ndarray  # -1 in a leaf
    threshold: np.ndarray
    left: np.ndarray  # the right child follows the left one
    value: np.ndarray
    rows: np.ndarray

    def cuts(self, x: np.ndarray, depths: Sequence[int | None], min_splits: Sequence[int]) -> np.ndarray:
        """Predictions for rows of ``x`` by every (depth, min_split) cut, depths ascending and None last."""
        at = np.zeros(len(x), np.int64)
        frozen = [self.rows[at] < m for m in min_splits]
        held = [self.value[at] for _ in min_splits]
        every = np.arange(len(x))
        out, level = np.empty((len(depths), len(min_splits), len(x))), 0
        for d, depth in enumerate(depths):
            while depth is None or level < depth:
                inner = self.feature[at] >= 0
                if not inner.any():
                    break
                f = self.feature[at]
                right = x[every, np.maximum(f, 0)] > self.threshold[at]
                at = np.where(inner, self.left[at] + right, at)
                level += 1
                for m, least in enumerate(min_splits):
                    held[m] = np.where(frozen[m], held[m], self.value[at])
                    frozen[m] = frozen[m] | (self.rows[at] < least)
            out[d] = held
        return out


def sorted_rows(x: np.ndarray) -> np.ndarray:
    """Per feature, the rows in order of their value."""
    return np.argsort(x, axis=0, kind="stable").T


def grow(
    x: np.ndarray,
    order: np.ndarray,
    y: np.ndarray,
    weight: np.ndarray | None = None,
    depth: int | None = None,
    min_split: int = 2,
    min_leaf: int = 1,
) -> Tree:
    """The tree that greedily lessens squared error.  ``order`` is :func:`sorted_rows` of ``x``; rows of weight 0 are out.

    Ties go to the first feature, then to the lowest threshold, which is the middle between two values.
    """
    d = x.shape[1]
    weight = np.ones(len(y)) if weight is None else weight.astype(float)
    if not weight.all():
        order = order[weight[order] > 0].reshape(d, -1)
    columns = np.ascontiguousarray(x.T)
    features, thresholds, lefts, values, sizes = [], [], [], [], []
    count, known, level = np.array([order.shape[1]]), 1, 0
    while len(count):
        k, m = len(count), order.shape[1]
        starts, at = np.cumsum(count) - count, np.arange(m)
        node = np.repeat(np.arange(k), count)
        rows = order[0]
        all_w = np.bincount(node, weights=weight[rows], minlength=k)
        value = np.bincount(node, weights=weight[rows] * y[rows], minlength=k) / all_w
        off = np.zeros(len(y))
        off[rows] = weight[rows] * (y[rows] - value[node])  # around the node's mean, so that no digits cancel
        spread = np.bincount(node, weights=off[rows] ** 2 / weight[rows], minlength=k) / all_w
        grows = (count >= max(min_split, 2 * min_leaf)) & (spread > 1e-12) & (depth is None or level < depth)
        w, wy = weight[order], off[order]
        sum_w, sum_wy = w.cumsum(1), wy.cumsum(1)
        left_w = sum_w - (sum_w[:, starts] - w[:, starts])[:, node]
        left_wy = sum_wy - (sum_wy[:, starts] - wy[:, starts])[:, node]
        place = at - starts[node]
        allowed = (place + 1 >= min_leaf) & (count[node] - place - 1 >= max(min_leaf, 1)) & grows[node]
        sorted_x = np.take_along_axis(columns, order, 1)
        rises = np.zeros((d, m), bool)
        rises[:, :-1] = sorted_x[:, 1:] > sorted_x[:, :-1] + 1e-7
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left_wy * left_wy * (1 / left_w + 1 / (all_w[node] - left_w))
        gain = np.where(rises & allowed, gain, -np.inf)
        best = np.maximum.reduceat(gain, starts, axis=1)
        most = best.max(0) * (1 - TIE)  # equal splits differ by rounding only
        feature = (best >= most).argmax(0)
        splits = grows & np.isfinite(most)
        hit = (gain[feature[node], at] >= most[node]) & splits[node]
        where = np.minimum(np.minimum.reduceat(np.where(hit, at, m), starts), m - 2)
        low, high = sorted_x[feature, where], sorted_x[feature, np.minimum(where + 1, m - 1)]
        threshold = (low + high) / 2
        threshold = np.where(threshold >= high, low, threshold)
        rank = np.cumsum(splits) - 1
        features.append(np.where(splits, feature, -1))
        thresholds.append(threshold)
        lefts.append(np.where(splits, known + 2 * rank, -1))
        values.append(value)
        sizes.append(count)
        known, level = known + 2 * int(splits.sum()), level + 1
        right = columns[feature[node], rows] > threshold[node]
        child = np.full(len(y), -1)
        child[rows] = np.where(splits[node], 2 * rank[node] + right, -1)
        stays = child[order] >= 0
        order = order[stays].reshape(d, -1)
        if not order.shape[1]:
            break
        key = child[order]
        key = key.astype(np.int16) if known < 2**15 else key
        order = np.take_along_axis(order, np.argsort(key, axis=1, kind="stable"), 1)
        count = np.bincount(child[child >= 0])
    return Tree(*(np.concatenate(c) for c in (features, thresholds, lefts, values, sizes)))


def forest_scores(
    x: np.ndarray,
    y: np.ndarray,
    test: np.ndarray,
    trees: Sequence[int],
    depths: Sequence[int | None],
    min_splits: Sequence[int],
    min_leaf: int,
    seed: int,
) -> Iterator[tuple[dict, np.ndarray]]:
    """Grid point and predictions for ``test`` of every forest that the largest one contains.

    Tree number i draws its sample with a generator of its own, so it is the same in every forest of the property.
    """
    order, total = sorted_rows(x), np.zeros((len(depths), len(min_splits), len(test)))
    for number in range(1, max(trees) + 1):
        drawn = np.random.default_rng([seed, number]).integers(len(y), size=len(y))
        tree = grow(x, order, y, np.bincount(drawn, minlength=len(y)), max(depths, key=lambda v: v or 1e9), min(min_splits), min_leaf)
        total += tree.cuts(test, depths, min_splits)
        if number in trees:
            for d, depth in enumerate(depths):
                for m, min_split in enumerate(min_splits):
                    point = {"trees": number, "depth": depth or 0, "min_leaf": min_leaf, "min_split": min_split}
                    yield point, total[d, m] / number


def boosting_scores(
    x: np.ndarray, y: np.ndarray, test: np.ndarray, trees: Sequence[int], rate: float, depth: int, min_split: int
) -> Iterator[tuple[dict, np.ndarray]]:
    """Grid point and predictions for ``test`` after each number of rounds; a round fits the residuals of the last."""
    order, now = sorted_rows(x), np.full(len(y), y.mean())
    told = np.full(len(test), y.mean())
    both = np.concatenate([x, test])
    for number in range(1, max(trees) + 1):
        tree = grow(x, order, y - now, None, depth, min_split)
        step = rate * tree.cuts(both, [None], [0])[0, 0]
        now, told = now + step[: len(y)], told + step[len(y) :]
        if number in trees:
            yield {"trees": number, "rate": rate, "depth": depth, "min_split": min_split}, told
