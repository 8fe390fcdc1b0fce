"""All trials and folds of the logistic regression fitted together.

A step evaluates the loss and gradient of every model in one pass over the blocks (a matrix product per block, sums added a fan of blocks at
a time); the limited-memory quasi-Newton update of the coefficient vectors runs on the driver, whose memory is a few vectors per
model. Models that have converged are left out of later passes.

Objective of a model: weighted mean log loss + reg / 2 * |w|^2, the intercept free.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnspark.operators.hist_trees import sigmoid
from churnspark.operators.tree_search import SUMS, added

#: Largest gradient entry of a converged model, passes at most, remembered steps.
TOLERANCE, PASSES, MEMORY = 1e-7, 300, 10
#: Rows of a matrix product.
STEP = 1 << 15


class Minimiser:
    """L-BFGS with halving line search for the rows of a matrix, each a problem of its own."""

    def __init__(self, models: int, size: int):
        self.x, self.f = np.zeros((models, size)), np.full(models, np.inf)
        self.g, self.direction = np.zeros((models, size)), np.zeros((models, size))
        self.step, self.done = np.zeros(models), np.zeros(models, bool)
        self.s, self.y, self.rho = np.zeros((MEMORY, models, size)), np.zeros((MEMORY, models, size)), np.zeros((MEMORY, models))

    def ask(self) -> np.ndarray:
        """Points to evaluate, one per model that is not done."""
        return (self.x + self.step[:, None] * self.direction)[~self.done]

    def tell(self, f: np.ndarray, g: np.ndarray) -> None:
        at = np.flatnonzero(~self.done)
        slope = np.einsum("ij,ij->i", self.g[at], self.direction[at])
        good = f <= self.f[at] + 1e-4 * self.step[at] * slope
        self.step[at[~good]] *= 0.5
        self.done[at[~good]] = self.step[at[~good]] < 1e-12
        a, f, g = at[good], f[good], g[good]
        s, y = self.step[a][:, None] * self.direction[a], g - self.g[a]
        sy = np.einsum("ij,ij->i", s, y)
        use = (sy > 1e-14) & np.isfinite(self.f[a])
        for store, new in ((self.s, s), (self.y, y)):
            store[1:, a[use]] = store[:-1, a[use]]
            store[0, a[use]] = new[use]
        self.rho[1:, a[use]] = self.rho[:-1, a[use]]
        self.rho[0, a[use]] = 1.0 / sy[use]
        self.x[a] += s
        self.f[a], self.g[a] = f, g
        self.done[a] = np.abs(g).max(axis=1) < TOLERANCE
        # two-loop recursion over all models that moved
        q, alpha = g.copy(), []
        for s_, y_, r_ in zip(self.s[:, a], self.y[:, a], self.rho[:, a]):
            alpha.append(r_ * np.einsum("ij,ij->i", s_, q))
            q -= alpha[-1][:, None] * y_
        yy = np.einsum("ij,ij->i", self.y[0, a], self.y[0, a])
        known = self.rho[0, a] > 0
        scale = np.where(known, 1.0 / np.maximum(self.rho[0, a] * yy, 1e-300), 1.0 / np.maximum(1.0, np.linalg.norm(g, axis=1)))
        q *= scale[:, None]
        for s_, y_, r_, al in reversed(list(zip(self.s[:, a], self.y[:, a], self.rho[:, a], alpha))):
            q += (al - r_ * np.einsum("ij,ij->i", y_, q))[:, None] * s_
        self.direction[a], self.step[a] = -q, 1.0


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = x @ w[:, :-1].T + w[:, -1]
    each = weights[:, y].T                        # (rows, models)
    r = each * (sigmoid(z) - y[:, None])
    loss = (each * (np.logaddexp(0, z) - y[:, None] * z)).sum(axis=0)
    return np.column_stack([loss, each.sum(axis=0), r.T @ x, r.sum(axis=0)])


def _pass(points: dict[int, np.ndarray], weights: dict[int, np.ndarray]):
    """Sums of loss, weight and gradient of every model over the training rows of a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fold, block, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if fold not in points:
                    continue
                x, y, _, held = pickle.loads(data)
                x, y = x[~held], y[~held]
                sums = sum(_sums(x[i:i + STEP], y[i:i + STEP], points[fold], weights[fold]) for i in range(0, max(1, len(y)), STEP))
                yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in (fold, 0, 0, block)), pa.array([pickle.dumps(sums)], pa.binary())],
                                                 names=["fold", "grp", "part", "block", "data"])
    return run


def fit_all(blocks: DataFrame, reg: dict[int, np.ndarray], weights: dict[int, np.ndarray], width: dict[int, int], n_blocks: int) -> dict[int, np.ndarray]:
    """Per fold the (models, features + 1) coefficients, intercept last.

    ``reg``: penalty of every model; ``weights``: (models, 2) weights of the negative and positive rows."""
    solvers = {f: Minimiser(len(r), width[f] + 1) for f, r in reg.items()}
    for _ in range(PASSES):
        open_ = {f: ~m.done for f, m in solvers.items() if not m.done.all()}
        if not open_:
            break
        points = {f: solvers[f].ask() for f in open_}
        sums = blocks.mapInArrow(_pass(points, {f: weights[f][o] for f, o in open_.items()}), SUMS)
        sums = added(sums, n_blocks * len(reg)) if n_blocks > 1 else sums   # the folds' blocks are numbered on
        for fold, data in sums.select("fold", "data").collect():   # one row per fold
            total, w = pickle.loads(data), points[fold]
            penalty = reg[fold][open_[fold]][:, None] * np.column_stack([w[:, :-1], np.zeros(len(w))])
            f = total[:, 0] / total[:, 1] + 0.5 * np.einsum("ij,ij->i", penalty, w)
            solvers[fold].tell(f, total[:, 2:] / total[:, 1:2] + penalty)
    return {f: m.x for f, m in solvers.items()}


def held_out_scores(blocks: DataFrame, coefficients: dict[int, np.ndarray]) -> DataFrame:
    """(trial, fold, label, p) of every validation row and model."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fold, _, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                x, y, _, held = pickle.loads(data)
                for trial, w in enumerate(coefficients[fold]):
                    p = sigmoid(x[held] @ w[:-1] + w[-1])
                    n = len(p)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, trial, np.int32)), pa.array(np.full(n, fold, np.int32)),
                                                      pa.array(y[held].astype(np.int32)), pa.array(p, pa.float64())], names=["trial", "fold", "label", "p"])
    return blocks.filter(F.col("fold").isin(list(coefficients))).mapInArrow(run, "trial int, fold int, label int, p double")
