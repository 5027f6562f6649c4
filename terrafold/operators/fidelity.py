"""How well a region's centre stands for its nodes' values: costs, best centres and the price of a merge, as expressions on arrays.

A region is known by its weight and the weighted sum of its values, which add up when regions merge; all that a partition by energy asks of a fidelity follows from them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-300


@dataclass(frozen=True)
class Fidelity:
    """cost(weight, value, centre) of a node; centre(weight, total), the cheapest for a region; loss(weight, total, weight, total) of a merge of two.

    costs(weights, values, centre), best(weight, total) and losses(weights, totals, weights, totals) are cost, centre and loss on NumPy arrays, a row per node or pair, for what fits into a task.
    corners: centres are labels (1 for one entry, 0 for the others), and a region is split between its two best.
    """

    cost: Callable[[Column, Column, Column], Column]
    centre: Callable[[Column, Column], Column]
    loss: Callable[[Column, Column, Column, Column], Column]
    costs: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    best: Callable[[float, np.ndarray], np.ndarray]
    losses: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    corners: bool = False


def added(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def mean(weight: Column, total: Column) -> Column:
    return F.transform(total, lambda t: t / weight)


def best_label(total: Column) -> Column:
    """1 at the first of the largest entries, else 0."""
    at = F.array_position(total, F.array_max(total)) - 1
    return F.transform(total, lambda _, i: F.when(i == at, 1.0).otherwise(0.0))


def second_label(total: Column) -> Column:
    """1 at the first of the largest of the other entries, else 0."""
    at = F.array_position(total, F.array_max(total)) - 1
    return best_label(F.transform(total, lambda t, i: F.when(i == at, F.lit(float("-inf"))).otherwise(t)))


def _apart(weight: Column, value: Column, centre: Column) -> Column:
    return 0.5 * weight * added(F.zip_with(value, centre, lambda y, c: (y - c) * (y - c)))


def _apart_loss(wa: Column, ta: Column, wb: Column, tb: Column) -> Column:
    return 0.5 * wa * wb / (wa + wb) * added(F.zip_with(ta, tb, lambda x, y: F.pow(x / wa - y / wb, 2)))


#: Half the squared distance.
SQUARED = Fidelity(_apart, mean, _apart_loss, lambda w, y, c: 0.5 * w * ((y - c) ** 2).sum(axis=1), lambda w, t: t / w, lambda wa, ta, wb, tb: 0.5 * wa * wb / (wa + wb) * ((ta / wa[:, None] - tb / wb[:, None]) ** 2).sum(axis=1))


def divergence(smoothing: float = 0.0) -> Fidelity:
    """The Kullback-Leibler divergence of distributions that are mixed with the uniform one: smoothing / size + (1 - smoothing) * p."""

    def smooth(p: Column, values: Column) -> Column:
        return smoothing / F.size(values) + (1 - smoothing) * p

    def apart(values: Column, centre: Column) -> Column:
        def term(y: Column, c: Column) -> Column:
            s = smooth(y, values)
            return F.when(s > 0, s * (F.ln(s) - F.ln(F.greatest(smooth(c, values), F.lit(TINY))))).otherwise(0.0)

        return added(F.zip_with(values, centre, term))

    def loss(wa: Column, ta: Column, wb: Column, tb: Column) -> Column:
        both = F.zip_with(ta, tb, lambda x, y: (x + y) / (wa + wb))
        return wa * apart(mean(wa, ta), both) + wb * apart(mean(wb, tb), both)

    def costs(w: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
        s, m = (smoothing / y.shape[1] + (1 - smoothing) * v for v in (y, c))
        return w * np.where(s > 0, s * (np.log(np.maximum(s, TINY)) - np.log(np.maximum(m, TINY))), 0.0).sum(axis=1)

    def losses(wa: np.ndarray, ta: np.ndarray, wb: np.ndarray, tb: np.ndarray) -> np.ndarray:
        both = (ta + tb) / (wa + wb)[:, None]
        return costs(wa, ta / wa[:, None], both) + costs(wb, tb / wb[:, None], both)

    return Fidelity(lambda w, y, c: w * apart(y, c), mean, loss, costs, lambda w, t: t / w, losses)


#: Less the value's entry at the region's label.
LINEAR = Fidelity(
    lambda w, y, c: -w * added(F.zip_with(y, c, lambda a, b: a * b)),
    lambda w, t: best_label(t),
    lambda wa, ta, wb, tb: F.array_max(ta) + F.array_max(tb) - F.array_max(F.zip_with(ta, tb, lambda x, y: x + y)),
    lambda w, y, c: -w * (y * c).sum(axis=1),
    lambda w, t: np.eye(len(t))[int(t.argmax())],
    lambda wa, ta, wb, tb: ta.max(axis=1) + tb.max(axis=1) - (ta + tb).max(axis=1),
    corners=True,
)
