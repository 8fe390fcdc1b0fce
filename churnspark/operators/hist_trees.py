"""Histogram trees for many models at once: the per-block arithmetic of ``tree_search``.

A batch is a list of trees (of many models) that grow side by side over one block of binned rows. A ``Grower`` keeps the shape of
the trees and knows nothing of rows: it names the nodes whose histograms it needs and is told their best splits, which come from
one block's histograms or from the sum of many blocks'. Everything random (row and column samples, bootstrap weights, score noise)
is a hash of seeds, row ids and node paths, so it does not depend on how rows are spread over blocks.

Rules (statistics G, H, N of a node; ``score`` of a node, gain = score of both children - score of the node):

newton     G gradient, H hessian: T(G)^2 / (H + l2), T the soft threshold by l1; half the gain less gamma; leaf T(G) / (H + l2)
friedman   G residual, N rows: G^2 / N; leaf G / H with H the sum of p (1 - p)
gini       G positive weight, H weight: minus the weighted impurity; leaf G / H
entropy    likewise with the binary entropy

Growth: ``level`` (all leaves of a level), ``leaf`` (best leaf first, a bounded number of leaves), ``oblivious`` (one split per level for all
its nodes, by the cosine of gradient and step, with noise).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np

#: Histogram cells handled together.
CELLS = 250_000
#: Rows of a block from which on trees grow one at a time over lists of rows, and of a node that has a list of its own.
LISTED, LONG = 1 << 15, 1024
#: Nodes with so many times ``LONG`` rows have histograms of all columns, even if they draw some.
WHOLE = 8
#: Cells of a bundle of columns: of the bundles for short lists of rows, and of those for lists from ``LISTED`` rows on.
BUNDLE, WIDE = 256, 4096
#: Where statistics are sums of whole weights per class, a row adds its weight times this, and 1 for itself: one sum holds both (rows stay below it).
PACKED = float(1 << 22)
#: Rows whose gradients and weights are computed together, and rows of a list that are gathered together.
STRIP, STRETCH = 1 << 14, 1 << 20
#: Cells of the score histogram behind the validation ROC-AUC, over margins in [-AUC_SPAN, AUC_SPAN].
AUC_CELLS, AUC_SPAN = 4096, 8.0
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(*keys) -> np.ndarray:
    """64-bit hash of the (broadcast) integer keys."""
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for k in keys:
            h = (h ^ np.asarray(k).astype(np.uint64)) + _GOLDEN
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return h


def uniform(*keys) -> np.ndarray:
    """In (0, 1), by hash."""
    return ((mixed(*keys) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


@dataclass
class Spec:
    """One model of a search."""
    trial: int
    fold: int
    rule: str = "newton"
    growth: str = "level"
    rounds: int = 1             # at most
    first: int = 0              # round that it begins with (a part of a forest)
    trees: int = 1              # of one round
    rate: float = 1.0
    depth: int = 6
    leaves: int = 1 << 30
    min_n: float = 1
    min_split: float = 2
    min_h: float = 0.0
    l1: float = 0.0
    l2: float = 0.0
    gamma: float = 0.0
    rows: str = "all"           # or bernoulli, bagging, poisson, bayes
    row_p: float = 1.0
    cols: float = 1.0           # share of the columns of a tree
    mtry: str = ""              # columns of a node: sqrt, log2 or all
    noise: float = 0.0
    stop: str = ""              # auc or logloss on the validation rows
    patience: int = 30
    init: float = 0.0
    w_pos: float = 1.0
    w_neg: float = 1.0
    n_train: int = 1
    seed: int = 42

    @property
    def boosts(self) -> bool:
        return self.rule in ("newton", "friedman")

    def parts(self, n: int) -> list[Spec]:
        """A forest as up to ``n`` smaller ones, whose trees together are its trees."""
        cuts = [self.rounds * i // n for i in range(n + 1)]
        return [replace(self, first=a, rounds=b) for a, b in zip(cuts, cuts[1:]) if a < b]

    @property
    def work(self) -> float:
        """Passes over the rows, roughly, where early stopping is as late as can be: small steps need more rounds."""
        return (self.rounds - self.first) * self.trees * (self.depth + 2) / (1 + 10 * self.rate if self.stop else 1)


@dataclass
class Batch:
    """Trees that grow together; arrays have one entry per tree."""
    rule: str
    growth: str
    bins: int
    depth: np.ndarray
    leaves: np.ndarray
    min_n: np.ndarray
    min_split: np.ndarray
    min_h: np.ndarray
    l1: np.ndarray
    l2: np.ndarray
    gamma: np.ndarray
    seed: np.ndarray
    cols: np.ndarray            # (trees, columns): usable columns
    mtry: np.ndarray            # columns of a node; 0: all
    noise: np.ndarray

    @property
    def size(self) -> int:
        return len(self.depth)

    def tree(self, t: int) -> Batch:
        """Tree ``t`` alone."""
        return Batch(self.rule, self.growth, self.bins, *(getattr(self, f)[t:t + 1] for f in list(self.__dataclass_fields__)[3:]))


def _smallest(scores: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Mask of the ``k[i]`` smallest entries of every row."""
    return scores.argsort(axis=1).argsort(axis=1) < k[:, None]


def make_batch(specs: list[Spec], r: int, d: int, bins: int) -> Batch:
    """The trees of round ``r``: ``trees`` per model, in the order of the models."""
    each = [s for s in specs for _ in range(s.trees)]
    number = np.concatenate([r * s.trees + np.arange(s.trees) for s in specs])
    seed = mixed([s.seed for s in each], [s.trial for s in each], number)

    def arr(name, dtype=float):
        return np.array([getattr(s, name) for s in each], dtype)

    share = arr("cols")
    cols = np.ones((len(each), d), bool)
    if (share < 1).any():
        cols = _smallest(uniform(seed[:, None], 101, np.arange(d)[None]), np.maximum(1, np.rint(share * d)).astype(int))
    mtry = np.array([{"sqrt": max(1, math.isqrt(d)), "log2": max(1, int(math.log2(d)))}.get(s.mtry, 0) for s in each])
    # the score noise fades as the model grows
    left = np.array([math.exp(min(50.0, math.log(max(s.n_train, 1)) - r * s.rate)) for s in each])
    return Batch(each[0].rule, each[0].growth, bins, arr("depth", int), arr("leaves", int), arr("min_n"), arr("min_split"), arr("min_h"),
                 arr("l1"), arr("l2"), arr("gamma"), seed, cols, mtry, arr("noise") * left / (1 + left))


def row_weights(spec: Spec, seeds: np.ndarray, r: int, ids: np.ndarray) -> np.ndarray:
    """(trees, rows) sample weights of a model's trees in round ``r``."""
    if spec.rows == "bernoulli":
        return (uniform(seeds[:, None], 7, ids[None]) < spec.row_p).astype(float)
    if spec.rows == "bagging":   # a new sample every five rounds
        return (uniform(mixed(spec.seed, spec.trial, r // 5), 7, ids)[None] < spec.row_p).astype(float)
    if spec.rows == "poisson":
        u = uniform(seeds[:, None], 7, ids[None])
        p = math.exp(-1) / np.cumprod([1, 1, 2, 3, 4, 5, 6, 7, 8])
        return sum(u > q for q in np.cumsum(p)).astype(float)
    if spec.rows == "bayes":
        return (-np.log(uniform(seeds[:, None], 7, ids[None]))) ** spec.row_p
    return np.ones((len(seeds), len(ids)))


def node_columns(batch: Batch, trees: np.ndarray, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Per node the columns it may split on and which of them count (rows are padded); None: all columns."""
    k = int(batch.mtry.max())
    if not k:
        return None
    u = uniform(batch.seed[trees][:, None], paths[:, None], np.arange(batch.cols.shape[1])[None])
    picked = np.argsort(u, axis=1)[:, :k]
    used = np.arange(k)[None] < batch.mtry[trees][:, None]
    order = np.argsort(picked, axis=1)
    return np.take_along_axis(picked, order, 1), np.take_along_axis(used, order, 1)


def histograms(x: np.ndarray, rows: np.ndarray, slots: np.ndarray, stats: list[np.ndarray], n: int, bins: int,
               columns: np.ndarray | None) -> np.ndarray:
    """(3, n, columns, bins) sums of the statistics of (row, slot) entries."""
    if columns is None:
        values, k = x[rows], x.shape[1]
    else:
        values, k = x[rows[:, None], columns[slots]], columns.shape[1]
    code = ((slots[:, None] * k + np.arange(k)) * bins + values).ravel()
    return np.stack([np.bincount(code, np.repeat(s, k), n * k * bins).reshape(n, k, bins) for s in stats])


def _node_score(rule: str, g, h, n, l1, l2):
    if rule == "newton":
        t = np.maximum(np.abs(g) - l1, 0.0)
        return t * t / (h + l2)
    if rule == "friedman":
        return g * g / n
    if rule == "gini":
        return -2.0 * g * (h - g) / h
    q = np.clip(g / h, 1e-12, 1 - 1e-12)
    return g * np.log(q) + (h - g) * np.log(1 - q)


def leaf_values(batch: Batch, trees: np.ndarray, stats: np.ndarray) -> np.ndarray:
    g, h, _ = stats
    if batch.rule == "newton":
        t = np.sign(g) * np.maximum(np.abs(g) - batch.l1[trees], 0.0)
        down = h + batch.l2[trees]
    else:
        t, down = g, h
    return np.divide(t, down, out=np.zeros_like(g), where=down > 1e-12)


@dataclass
class Best:
    """Best split of each node asked for: usable or not, gain, column, bin (rows with a bin up to it go left), statistics."""
    ok: np.ndarray
    gain: np.ndarray
    column: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray


def choose(batch: Batch, hist: np.ndarray, trees: np.ndarray, paths: np.ndarray) -> Best:
    """Best splits from the nodes' histograms (for oblivious trees: all nodes of a level, tree by tree)."""
    picked = node_columns(batch, trees, paths)
    columns, used = picked if picked else (None, batch.cols[trees])
    cum = np.cumsum(hist, axis=3)
    total = cum[:, :, :1, -1:]
    left = cum[..., :-1]
    right = total - left
    a, k, cuts = left.shape[1:]

    def per(x):
        return x[trees][:, None, None]

    with np.errstate(divide="ignore", invalid="ignore"):
        if batch.growth == "oblivious":
            first = np.flatnonzero(np.append(True, trees[1:] != trees[:-1]))
            num, den, some = np.zeros((a, k, cuts)), np.zeros((a, k, cuts)), []
            for side in (left, right):
                v = side[0] / (side[2] + per(batch.l2))
                num += side[0] * v
                den += side[2] * v * v
                some.append(np.add.reduceat(side[2], first) > 0)
            gain = np.add.reduceat(num, first) / np.sqrt(np.add.reduceat(den, first))
            t = trees[first]
            noise = batch.noise[t]
            if noise.any():   # scaled by the spread of the gradients
                tot = np.add.reduceat(total[:, :, 0, 0], first, axis=1)
                u = [uniform(batch.seed[t][:, None, None], 31 + i, paths[first][:, None, None], np.arange(k)[None, :, None], np.arange(cuts))
                     for i in range(2)]
                normal = np.sqrt(-2 * np.log(u[0])) * np.cos(2 * np.pi * u[1])
                gain = gain + (noise * np.sqrt(tot[1] / np.maximum(tot[2], 1e-12)))[:, None, None] * normal
            valid = some[0] & some[1] & used[first][:, :, None] & ~np.isnan(gain)
            gain, valid = (np.repeat(z, np.diff(np.append(first, a)), axis=0) for z in (gain, valid))
            floor = -np.inf
        else:
            args = per(batch.l1), per(batch.l2)
            gain = sum(_node_score(batch.rule, *s, *args) for s in (left, right)) - _node_score(batch.rule, *total, *args)
            if batch.rule == "newton":
                gain = 0.5 * gain - per(batch.gamma)
            valid = ((left[2] >= per(batch.min_n)) & (right[2] >= per(batch.min_n)) & (left[1] >= per(batch.min_h))
                     & (right[1] >= per(batch.min_h)) & used[:, :, None])
            floor = 1e-9
    flat = np.where(valid, gain, -np.inf).reshape(a, -1)
    at = flat.argmax(axis=1)
    i = np.arange(a)
    best = flat[i, at]
    c, b = at // cuts, at % cuts
    return Best(best > floor, best, c if columns is None else columns[i, c], b, left[:, i, c, b], right[:, i, c, b])


def joined(parts: list[Best]) -> Best:
    return Best(*(np.concatenate([getattr(p, f) for p in parts], axis=-1) for f in Best.__dataclass_fields__))


class Grower:
    """The growing trees of a batch; nodes are numbered over the whole batch, roots first, the two children of a node in a row."""

    NODE = {"feature": np.int32, "bin": np.int32, "left": np.int64, "parent": np.int64, "tree": np.int64, "level": np.int64,
            "path": np.uint64, "gain": float, "ok": bool, "c_feature": np.int32, "c_bin": np.int32}

    def __init__(self, batch: Batch):
        self.batch = batch
        t = np.arange(batch.size)
        self._new(t, np.full(len(t), -1), np.zeros(len(t), int), np.ones(len(t), np.uint64), np.zeros((3, len(t))))
        self.active, self.split, self.kept = t, t[:0], None

    def _new(self, tree, parent, level, path, stats):
        n = len(tree)
        fresh = {"feature": np.full(n, -1), "bin": np.zeros(n), "left": np.full(n, -1), "parent": parent, "tree": tree, "level": level,
                 "path": path, "gain": np.zeros(n), "ok": np.zeros(n, bool), "c_feature": np.zeros(n), "c_bin": np.zeros(n)}
        for name, dtype in self.NODE.items():
            values = np.asarray(fresh[name]).astype(dtype)
            setattr(self, name, np.concatenate([getattr(self, name), values]) if hasattr(self, name) else values)
        for name, values in (("stats", stats), ("c_left", np.zeros((3, n))), ("c_right", np.zeros((3, n)))):
            setattr(self, name, np.concatenate([getattr(self, name), values], axis=1) if hasattr(self, name) else values)

    def step(self, best: Best) -> None:
        """Take the best splits of the active nodes, split what the growth rule splits, and name the next active nodes."""
        a, b = self.active, self.batch
        self.ok[a], self.gain[a], self.c_feature[a], self.c_bin[a] = best.ok, best.gain, best.column, best.bin
        self.c_left[:, a], self.c_right[:, a] = best.left, best.right
        roots = a < b.size
        self.stats[:, a[roots]] = (best.left + best.right)[:, roots]
        self.split = self._popped() if b.growth == "leaf" else a[self.ok[a]]
        s, at = self.split, len(self.tree)
        self.feature[s], self.bin[s], self.left[s] = self.c_feature[s], self.c_bin[s], at + 2 * np.arange(len(s))
        stats = np.stack([self.c_left[:, s], self.c_right[:, s]], axis=2).reshape(3, -1)
        two = np.repeat(s, 2)
        path = self.path[two] * np.uint64(2) + np.tile(np.array([0, 1], np.uint64), len(s))
        self._new(self.tree[two], two, self.level[two] + 1, path, stats)
        new = np.arange(at, len(self.tree))
        t = self.tree[new]
        may = self.level[new] < b.depth[t]
        if b.growth != "oblivious":
            n, h = self.stats[2, new], self.stats[1, new]
            may &= (n >= b.min_split[t]) & (n >= 2 * b.min_n[t]) & (h >= 2 * b.min_h[t])
        self.active = new[may]

    def _popped(self) -> np.ndarray:
        """Best leaf first over what is known: the nodes that would be split and are not yet. ``kept``: all that would be."""
        kept = np.zeros(len(self.tree), bool)
        for t in range(self.batch.size):
            heap, leaves = [(-self.gain[t], t)] if self.ok[t] else [], 1
            while heap and leaves < self.batch.leaves[t]:
                _, i = heapq.heappop(heap)
                kept[i] = True
                leaves += 1
                if self.left[i] >= 0:
                    for c in (self.left[i], self.left[i] + 1):
                        if self.ok[c]:
                            heapq.heappush(heap, (-self.gain[c], int(c)))
        self.kept = kept
        return np.flatnonzero(kept & (self.left < 0))

    def values(self) -> np.ndarray:
        """The leaf value that a row in each node gets; a node below a leaf of the final tree has that leaf's."""
        value = leaf_values(self.batch, self.tree, self.stats)
        if self.kept is not None:
            kept = np.append(self.kept, np.zeros(len(self.tree) - len(self.kept), bool))
            inner = np.flatnonzero(self.parent >= 0)
            below = np.zeros(len(self.tree), bool)
            for i in inner[~kept[self.parent[inner]]]:   # parents come before their children
                value[i], below[i] = value[self.parent[i]], True
            self.left = np.where(kept, self.left, -1)
            self.feature = np.where(kept, self.feature, -1).astype(np.int32)
        return value

    def export(self, value: np.ndarray) -> list[dict]:
        """Per tree its nodes: feature (-1: leaf), bin, left child (the right one follows), value, gain, rows."""
        out = []
        reach = self.parent < 0
        for i in np.flatnonzero(self.parent >= 0):
            reach[i] = reach[self.parent[i]] and self.left[self.parent[i]] >= 0
        for t in range(self.batch.size):
            ids = np.flatnonzero((self.tree == t) & reach)
            place = {int(j): k for k, j in enumerate(ids)}
            left = np.array([place[int(j)] if j >= 0 else -1 for j in self.left[ids]], np.int32)
            out.append({"feature": self.feature[ids], "bin": self.bin[ids], "left": left, "value": value[ids],
                        "gain": np.where(left >= 0, self.gain[ids], 0.0), "cover": self.stats[2, ids]})
        return out


def chunks(grower: Grower, d: int) -> list[np.ndarray]:
    """The active nodes (by tree) in parts of at most ``CELLS`` histogram cells; oblivious trees are not cut apart."""
    a = grower.active[np.argsort(grower.tree[grower.active], kind="stable")]
    grower.active = a
    k = int(grower.batch.mtry.max()) or d
    most = max(1, CELLS // (k * grower.batch.bins))
    if grower.batch.growth != "oblivious":
        return [a[i:i + most] for i in range(0, len(a), most)]
    cut, at, out = np.flatnonzero(np.append(grower.tree[a][1:] != grower.tree[a][:-1], True)) + 1, 0, []
    for i, end in enumerate(cut):
        if i + 1 == len(cut) or cut[i + 1] - at > most:
            out.append(a[at:end])
            at = end
    return out


def node_histograms(grower: Grower, nodes: np.ndarray, x: np.ndarray, node: np.ndarray, stats: list[np.ndarray]) -> np.ndarray:
    """Histograms of ``nodes`` (sorted by tree) over one block; ``node``: (trees, rows) the node each row is in."""
    b = grower.batch
    first, last = grower.tree[nodes[0]], grower.tree[nodes[-1]] + 1
    slot = np.full(len(grower.tree), -1)
    slot[nodes] = np.arange(len(nodes))
    here = slot[node[first:last]]
    t, rows = np.nonzero((here >= 0) & (stats[2][first:last] > 0))
    picked = node_columns(b, grower.tree[nodes], grower.path[nodes])
    return histograms(x, rows, here[t, rows], [s[first:last][t, rows] for s in stats], len(nodes), b.bins, picked[0] if picked else None)


def route(grower: Grower, x: np.ndarray, node: np.ndarray) -> None:
    """Move rows out of the nodes split last."""
    moved = np.zeros(len(grower.tree), bool)
    moved[grower.split] = True
    t, rows = np.nonzero(moved[node])
    at = node[t, rows]
    node[t, rows] = grower.left[at] + (x[rows, grower.feature[at]] > grower.bin[at])


def walk(grower: Grower, x: np.ndarray) -> np.ndarray:
    """(trees, rows) node of every row, from the roots."""
    node = np.repeat(np.arange(grower.batch.size)[:, None], len(x), axis=1)
    while True:
        inner = grower.left[node] >= 0
        if not inner.any():
            return node
        t, rows = np.nonzero(inner)
        at = node[t, rows]
        node[t, rows] = grower.left[at] + (x[rows, grower.feature[at]] > grower.bin[at])


class Columns:
    """A block's columns one after the other, and bundles of them: a bundle's code stands for the bins of several columns, so one pass counts all."""

    def __init__(self, x: np.ndarray, y: np.ndarray | None = None):
        """``y``: labels that the cells tell apart; statistics are then one array of whole weights (``PACKED``), summed per class."""
        self.n, self.d = x.shape
        self.x, self.y = np.ascontiguousarray(x.T), None if y is None else y.astype(np.uint8)
        self.flat = self.x.reshape(-1)
        top = int(self.x.max(initial=0)) * 2 + 1
        self.cells = self.x if y is None else self.x.astype(np.min_scalar_type(top)) * self.y.dtype.type(2) + self.y
        self.cells_flat = self.cells.reshape(-1)
        self.weights = 1.0, 1.0      # of a negative and of a positive row
        sizes = [int(c.max()) + 1 for c in self.x]
        self.bundles, self.wide = self._bundled(sizes, BUNDLE), self._bundled(sizes, WIDE)
        # filled anew by every histogram: fresh arrays of this size cost as much as the gathering
        self.stretch = STRETCH if self.n <= STRETCH else STRETCH // 4
        most = min(self.n, self.stretch)
        self.space, self.at = [np.empty(most) for _ in range(3 if y is None else 1)], np.empty(most, np.intp)

    def _bundled(self, sizes: list[int], cells: int) -> list[tuple[np.ndarray, list[int], list[int]]]:
        groups: list[list[int]] = []
        for c in sorted(range(self.d), key=lambda c: -sizes[c]):
            home = next((g for g in groups if math.prod(sizes[i] for i in g) * sizes[c] <= cells), None)
            if home is None:
                groups.append([c])
            else:
                home.append(c)
        out = []
        for g in groups:
            if len(g) == 1:
                out.append((self.cells[g[0]], g, [sizes[g[0]]]))
                continue
            code = np.zeros(self.n, np.int32)
            for c in g:
                code = code * sizes[c] + self.x[c]
            if self.y is not None:
                code = code * 2 + self.y
            out.append((code.astype(np.min_scalar_type(int(code.max()))), g, [sizes[c] for c in g]))
        return out

    def _gathered(self, rows: np.ndarray, stats: list[np.ndarray], counted: bool) -> list[np.ndarray | None]:
        return [None if counted and k == 2 else s.take(rows, out=space[:len(rows)], mode="clip") for k, (s, space) in enumerate(zip(stats, self.space))]

    def _codes(self, code: np.ndarray, rows: np.ndarray) -> np.ndarray:
        at = self.at[:len(rows)]
        at[:] = code.take(rows)
        return at

    def _sums(self, at: np.ndarray, values: list[np.ndarray | None], cells: int) -> list[np.ndarray]:
        """The three statistics of every cell."""
        if self.y is None:
            return [np.bincount(at, v, cells) for v in values]
        return self._unpacked(np.bincount(at, values[0], 2 * cells).reshape(cells, 2))

    def _unpacked(self, both: np.ndarray) -> np.ndarray:
        """(3, ...): the three statistics of cells (..., 2) of the negative and of the positive rows' ``PACKED`` sums."""
        weight = np.floor(both / PACKED)
        count = both - weight * PACKED
        neg, pos = weight[..., 0] * self.weights[0], weight[..., 1] * self.weights[1]
        return np.stack([pos, pos + neg, count[..., 0] + count[..., 1]])

    def _stretches(self, count, rows: np.ndarray, *more) -> np.ndarray:
        """The sums that ``count`` gives for a stretch of ``rows`` (and of the arrays beside them) at a time, added up."""
        total = None
        for i in range(0, max(1, len(rows)), self.stretch):
            part = slice(i, i + self.stretch)
            one = count(rows[part].astype(np.intp), *(m[part] for m in more))
            total = one if total is None else total + one
        return total

    def histograms(self, rows: np.ndarray, stats: list[np.ndarray], bins: int, used: np.ndarray, counted: bool) -> np.ndarray:
        """(3, columns, bins) sums over ``rows``; unused columns may stay 0 (but the first one, whose sum is the node's). ``counted``: the last
        statistic is 1 for every row."""
        return self._stretches(lambda part: self._all(part, stats, bins, used, counted), rows)

    def _all(self, rows: np.ndarray, stats: list[np.ndarray], bins: int, used: np.ndarray, counted: bool) -> np.ndarray:
        out = np.zeros((3, self.d, bins)) if self.y is None else np.zeros((self.d, bins, 2))
        values = self._gathered(rows, stats, counted)
        for code, columns, sizes in self.wide if len(rows) >= LISTED else self.bundles:
            if not used[columns].any() and 0 not in columns:
                continue
            at, cells = self._codes(code, rows), math.prod(sizes)
            if self.y is not None:   # whole numbers: their sums can be unpacked together
                h = np.bincount(at, values[0], 2 * cells).reshape(*sizes, 2)
                for i, c in enumerate(columns):
                    out[c, :sizes[i]] = h if len(sizes) == 1 else h.sum(axis=tuple(j for j in range(len(sizes)) if j != i))
                continue
            for k, h in enumerate(self._sums(at, values, cells)):
                h = h.reshape(sizes)
                for i, c in enumerate(columns):
                    out[k, c, :sizes[i]] = h if len(sizes) == 1 else h.sum(axis=tuple(j for j in range(len(sizes)) if j != i))
        return out if self.y is None else self._unpacked(out)

    def some(self, rows: np.ndarray, columns: np.ndarray, stats: list[np.ndarray], bins: int, counted: bool) -> np.ndarray:
        """(3, len(columns), bins) sums over ``rows`` of these columns."""
        return self._stretches(lambda part: self._some(part, columns, stats, bins, counted), rows)

    def _some(self, rows: np.ndarray, columns: np.ndarray, stats: list[np.ndarray], bins: int, counted: bool) -> np.ndarray:
        values = self._gathered(rows, stats, counted)
        if self.y is not None:
            both = [np.bincount(self._codes(self.cells[c], rows), values[0], 2 * bins) for c in columns]
            return self._unpacked(np.stack(both).reshape(len(columns), bins, 2))
        out = np.empty((3, len(columns), bins))
        for j, c in enumerate(columns):
            out[:, j] = self._sums(self._codes(self.cells[c], rows), values, bins)
        return out

    def pooled(self, rows: np.ndarray, slots: np.ndarray, stats: list[np.ndarray], n: int, bins: int, columns: np.ndarray | None,
               counted: bool) -> np.ndarray:
        """``histograms`` of the (row, slot) entries, a column at a time."""
        return self._stretches(lambda part, at: self._pooled(part, at, stats, n, bins, columns, counted), rows, slots)

    def _pooled(self, rows: np.ndarray, slots: np.ndarray, stats: list[np.ndarray], n: int, bins: int, columns: np.ndarray | None,
                counted: bool) -> np.ndarray:
        k = self.d if columns is None else columns.shape[1]
        out = np.empty((3, n, k, bins))
        values = self._gathered(rows, stats, counted)
        first = slots * (bins if self.y is None else 2 * bins)
        for j in range(k):
            at = self.cells[j].take(rows) if columns is None else self.cells_flat.take(columns[:, j].take(slots) * self.n + rows)
            for i, h in enumerate(self._sums(first + at, values, n * bins)):
                out[i, :, j] = h.reshape(n, bins)
        return out

    def right(self, rows: np.ndarray, features: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """Whether each row goes right of its node's split."""
        return self.flat.take(features.astype(np.int64) * self.n + rows) > bins

    def beyond(self, rows: np.ndarray, column: int, cut: int) -> np.ndarray:
        """Whether each row goes right of one split."""
        out, x = np.empty(len(rows), bool), self.x[column]
        for i in range(0, len(rows), self.stretch):
            part = slice(i, i + self.stretch)
            np.greater(x.take(rows[part]), cut, out=out[part])
        return out


def grow_listed(grower: Grower, c: Columns, stats: list[np.ndarray], inside: np.ndarray, outside: np.ndarray) -> tuple[list, list]:
    """Grow the one tree of ``grower``; ``inside``: its sampled training rows, ``outside``: the others (numbers below 2^31). Returns, for
    either kind, (rows, node or nodes).

    A node of many rows has them as lists; of two children the one with fewer rows is counted, the other is the rest of the parent, also where the
    columns of a node are drawn and all of them take few passes. Rows of small nodes are pooled and counted together."""
    b = grower.batch
    counted, drawn = b.growth != "oblivious", int(b.mtry.max())
    whole_nodes = not drawn or len(c.bundles) <= 2 * drawn
    lists, hists = {0: (inside, outside)}, {}
    pool = [[np.zeros(0, np.int32), np.zeros(0, np.int32)] for _ in range(2)]       # rows and their nodes: inside, outside

    def sums(nodes: np.ndarray) -> np.ndarray:
        picked = node_columns(b, grower.tree[nodes], grower.path[nodes])
        out = np.zeros((3, len(nodes), picked[0].shape[1] if drawn else c.d, b.bins))
        slot = np.full(len(grower.tree), -1)
        for i, node in enumerate(nodes.tolist()):
            if node in hists:
                out[:, i] = hists[node][:, picked[0][i]] if drawn else hists[node]
            elif drawn and node in lists:
                out[:, i] = c.some(lists[node][0], picked[0][i], stats, b.bins, counted)
            else:
                slot[node] = i
        at = slot[pool[0][1]]
        here = at >= 0
        if here.any():
            rows = pool[0][0].compress(here)
            out += c.pooled(rows, at.compress(here), stats, len(nodes), b.bins, picked[0] if drawn else None, counted)
        return out

    if whole_nodes:
        hists[0] = c.histograms(inside, stats, b.bins, b.cols[0], counted)
    while len(grower.active):
        grower.step(joined([choose(b, sums(nodes), grower.tree[nodes], grower.path[nodes]) for nodes in chunks(grower, c.d)]))
        active, moved = set(grower.active.tolist()), np.zeros(len(grower.tree), bool)
        moved[grower.split] = True
        for part in pool:
            go = np.flatnonzero(moved[part[1]])
            at = part[1].take(go)
            part[1][go] = grower.left[at] + c.right(part[0].take(go), grower.feature[at], grower.bin[at])
        short = [[], []]
        for node in grower.split.tolist():
            whole = hists.pop(node, None)
            if node not in lists:
                continue
            column, cut, left = int(grower.feature[node]), int(grower.bin[node]), int(grower.left[node])
            two = [[], []]
            for rows in lists.pop(node):
                right = c.beyond(rows, column, cut)
                two[1].append(rows.compress(right))
                two[0].append(rows.compress(np.logical_not(right, out=right)))
            for child, own in zip((left, left + 1), two):
                if len(own[0]) >= LONG:
                    lists[child] = tuple(own)
                else:
                    for k in range(2):
                        short[k].append((own[k], np.full(len(own[k]), child, np.int32)))
            few = int(len(two[1][0]) < len(two[0][0]))
            long = not drawn or len(two[1 - few][0]) >= WHOLE * LONG     # in small nodes the drawn columns take less
            if whole is not None and long and (left in active or left + 1 in active):
                less = c.histograms(two[few][0], stats, b.bins, b.cols[0], counted)
                rest = whole - less
                if not counted:
                    rest[:, rest[2] < 1e-9] = 0.0     # what is left of no row
                for child, h in ((left + few, less), (left + 1 - few, rest)):
                    if child in active:
                        hists[child] = h
        for part, more in zip(pool, short):
            if more:
                part[:] = [np.concatenate([part[j], *(m[j] for m in more)]) for j in range(2)]
    return tuple([(both[k], node) for node, both in lists.items()] + [tuple(pool[k])] for k in range(2))


def sigmoid(m: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(m, -500, 500)))


@dataclass
class Block:
    """Rows of one fold's data: binned features, labels, hashed ids, validation flags, and the state of a group of models."""
    x: np.ndarray
    y: np.ndarray
    ids: np.ndarray
    held: np.ndarray
    specs: list[Spec]
    bins: int
    margin: np.ndarray = None               # (models, rows)
    best_margin: np.ndarray = None          # of the validation rows, at the best round
    round: int = 0
    done: np.ndarray = None                 # (models,)
    best: np.ndarray = None
    best_round: np.ndarray = None
    trees: list = field(default_factory=list)
    columns: Columns = None
    bags: dict = None                       # per model its sample of several rounds: (round it began with, rows inside, outside)
    filled: tuple = None                    # of a tree over lists of rows: weight, gradient, hessian

    def start(self) -> Block:
        m = len(self.specs)
        if self.listed and (self.held[:-1] > self.held[1:]).any():   # training rows first
            order = np.argsort(self.held, kind="stable")
            self.x, self.y, self.ids, self.held = self.x[order], self.y[order], self.ids[order], self.held[order]
        self.margin = np.repeat(np.array([s.init for s in self.specs])[:, None], len(self.y), axis=1)
        self.best_margin = self.margin[:, self.held].copy()
        self.done, self.best, self.best_round = np.zeros(m, bool), np.full(m, -np.inf), np.zeros(m, int)
        self.round = min((s.first for s in self.specs), default=0)
        return self

    @property
    def listed(self) -> bool:
        return len(self.y) >= LISTED

    @property
    def validation_rows(self) -> slice | np.ndarray:
        return slice(int((~self.held).sum()), None) if self.listed else self.held

    def growing(self) -> np.ndarray:
        """Models that grow in this round."""
        return np.flatnonzero(~self.done & (self.round < np.array([s.rounds for s in self.specs])))

    def statistics(self, which: np.ndarray, batch: Batch) -> list[np.ndarray]:
        """(trees, rows) of the three statistics, zero for validation rows and rows not sampled."""
        out, at = [[], [], []], 0
        for i in which:
            s = self.specs[i]
            seeds = batch.seed[at:at + s.trees]
            at += s.trees
            w = row_weights(s, seeds, self.round, self.ids) * ~self.held
            count = w if s.growth == "oblivious" else (w > 0).astype(float)
            w = w * np.where(self.y, s.w_pos, s.w_neg)
            if s.boosts:
                p = sigmoid(self.margin[i])
                parts = w * (self.y - p), w * np.maximum(p * (1 - p), 1e-16), count
            else:
                parts = w * self.y, w, count
            for o, v in zip(out, parts):
                o.append(v)
        return [np.concatenate(o) for o in out]

    def add(self, which: np.ndarray, values: np.ndarray) -> None:
        """Add the trees' values (trees, rows) to the margins."""
        at = 0
        for i in which:
            s = self.specs[i]
            self.margin[i] += s.rate * values[at:at + s.trees].sum(axis=0)
            at += s.trees

    def validation(self, which: np.ndarray) -> np.ndarray:
        """(models, cells) sums that ``validation_score`` needs; blocks' sums add up."""
        part = self.validation_rows
        m, y = self.margin[:, part][which], self.y[part]
        cell = np.clip((m + AUC_SPAN) * (AUC_CELLS / (2 * AUC_SPAN)), 0, AUC_CELLS - 1).astype(int)
        code = (np.arange(len(which))[:, None] * 2 + y) * AUC_CELLS + cell
        out = np.bincount(code.ravel(), minlength=len(which) * 2 * AUC_CELLS).reshape(len(which), -1).astype(float)
        loss = np.logaddexp(0, m).sum(axis=1) - m[:, y == 1].sum(axis=1)
        return np.column_stack([out, loss])

    def judge(self, which: np.ndarray, sums: np.ndarray) -> list[int]:
        """Early stopping from the validation sums of all blocks of the fold; returns the models that are better than before."""
        better = []
        for i, row in zip(which, sums):
            s = self.specs[i]
            if not s.stop:
                continue
            score = validation_score(row, s.stop)
            if score > self.best[i] + 1e-12:
                self.best[i], self.best_round[i] = score, self.round + 1
                better.append(int(i))
            self.done[i] = self.round + 1 - self.best_round[i] >= s.patience
        return better

    def remember(self, better: list[int]) -> None:
        """Keep the validation margins of the models that are better than before."""
        for i in better:
            self.best_margin[i] = self.margin[i, self.validation_rows]

    def grow(self, rounds: int, keep: bool = False) -> Block:
        """Up to ``rounds`` rounds where this block is all of the fold's data."""
        for _ in range(rounds):
            which = self.growing()
            if not len(which):
                break
            batch = make_batch([self.specs[i] for i in which], self.round, self.x.shape[1], self.bins)
            if self.listed:
                self._grow_listed(which, batch, keep)
            else:
                self._grow_together(which, batch, keep)
            if any(self.specs[i].stop for i in which):
                self.remember(self.judge(which, self.validation(which)))
            self.round += 1
        return self

    def _grow_listed(self, which: np.ndarray, batch: Batch, keep: bool) -> None:
        """Tree after tree: the memory is that of one tree, whatever the number of models."""
        if self.columns is None:
            self.columns, self.bags = Columns(self.x, None if self.specs[0].boosts else self.y), {}
        n, at = int((~self.held).sum()), 0
        rest = np.arange(n, len(self.y), dtype=np.int32)
        w, g, h = self.statistic
        for i in which:
            s = self.specs[i]
            self.columns.weights = s.w_neg, s.w_pos
            # a forest's trees do not follow from its margins: of a model that is not kept the validation rows' are enough
            all_rows = s.boosts or keep
            total = np.zeros(len(self.y)) if s.trees > 1 else self.margin[i]
            for t in range(at, at + s.trees):
                inside, outside = self._sample(int(i), batch.seed[t:t + 1], n, w)
                if s.boosts:
                    self._weighted(int(i), n, w, g, h, t == at)
                    stats = [g, h, w if s.growth == "oblivious" else None]    # the last of the rows inside; None: 1 each
                else:
                    stats = [np.add(np.multiply(w, PACKED, out=g), 1.0, out=g)]
                grower = Grower(batch.tree(t))
                ends = grow_listed(grower, self.columns, stats, inside, np.concatenate([outside, rest]) if all_rows else rest)
                value = grower.values()
                step = value if s.trees > 1 else s.rate * value
                for rows, node in ends[0] + ends[1] if all_rows else ends[1]:
                    for k in range(0, len(rows), self.columns.stretch):
                        part = slice(k, k + self.columns.stretch)
                        np.add.at(total, rows[part].astype(np.intp), step[node if np.isscalar(node) else node[part]])
                if keep:
                    self.trees += grower.export(value)
            if s.trees > 1:
                total *= s.rate
                self.margin[i] += total
            at += s.trees

    @property
    def statistic(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A tree's weight, gradient and hessian of the training rows, filled anew for every tree."""
        if self.filled is None:
            n = int((~self.held).sum())
            kinds = {s.rows for s in self.specs} - {"all", "bernoulli", "bagging"}
            plain = not kinds and not any(s.growth == "oblivious" or not s.boosts for s in self.specs)   # nothing reads the weights
            self.filled = np.ones(STRIP if plain else n), np.empty(n), np.empty(n if self.specs[0].boosts else 0)
        return self.filled

    def _sample(self, i: int, seed: np.ndarray, n: int, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training rows in and not in a tree's sample; weights that are not only 0 and 1 go to ``w``."""
        s = self.specs[i]
        if s.rows == "all":
            return np.arange(n, dtype=np.int32), np.zeros(0, np.int32)
        begun = self.round - self.round % 5
        if s.rows == "bagging" and self.bags.get(i, (None,))[0] == begun:
            return self.bags[i][1:]
        found = [], []
        for k in range(0, n, STRIP):
            one = row_weights(s, seed, self.round, self.ids[k:min(k + STRIP, n)])[0]
            if len(w) == n:
                w[k:k + STRIP] = one
            for rows, there in zip(found, (one > 0, one <= 0)):
                rows.append((np.flatnonzero(there) + k).astype(np.int32))
        found = tuple(np.concatenate(rows) for rows in found)
        if s.rows == "bagging":
            self.bags[i] = begun, *found
        return found

    def _weighted(self, i: int, n: int, w: np.ndarray, g: np.ndarray, h: np.ndarray, first: bool) -> None:
        """Gradient and hessian of the rows in a tree's sample (others get any value); ``first``: of the model's trees in this round."""
        s = self.specs[i]
        weighed = s.rows in ("poisson", "bayes")
        if not weighed and not first:
            return
        for k in range(0, n, STRIP):
            part = slice(k, min(k + STRIP, n))
            y = self.y[part]
            c = np.where(y, s.w_pos, s.w_neg)
            if weighed:
                c = w[part] * c
            p = sigmoid(self.margin[i, part])
            g[part], h[part] = c * (y - p), c * np.maximum(p * (1 - p), 1e-16)

    def _grow_together(self, which: np.ndarray, batch: Batch, keep: bool) -> None:
        """All trees of a round side by side."""
        stats, grower = self.statistics(which, batch), Grower(batch)
        node = np.repeat(np.arange(batch.size)[:, None], len(self.y), axis=1)
        while len(grower.active):
            parts = [choose(batch, node_histograms(grower, c, self.x, node, stats), grower.tree[c], grower.path[c])
                     for c in chunks(grower, self.x.shape[1])]
            grower.step(joined(parts))
            route(grower, self.x, node)
        value = grower.values()
        self.add(which, value[node])
        if keep:
            self.trees += grower.export(value)

    def finished(self) -> Block:
        """Less what only growing needs: scores, best rounds and trees stay."""
        self.y, self.margin, self.held = self.y[self.held], self.margin[:, self.held], self.held[self.held]
        self.x = self.ids = self.columns = self.bags = self.filled = None
        return self

    def pieces(self, rows: int) -> Iterator[Block]:
        """A finished block in parts of so many rows."""
        for i in range(0, max(1, len(self.y)), rows):
            part = slice(i, i + rows)
            yield replace(self, y=self.y[part], held=self.held[part], margin=self.margin[:, part], best_margin=self.best_margin[:, part])

    def scores(self) -> np.ndarray:
        """(models, validation rows) probabilities, at the best round where the model stops early."""
        out = []
        for i, s in enumerate(self.specs):
            m = self.best_margin[i] if s.stop else self.margin[i, self.held]
            out.append(sigmoid(m) if s.boosts else m / (s.rounds * s.trees))
        return np.array(out).reshape(len(self.specs), int(self.held.sum()))


def validation_score(row: np.ndarray, kind: str) -> float:
    """Higher is better: ROC-AUC of the score histogram (ties count half), or minus the log loss."""
    neg, pos = row[:AUC_CELLS], row[AUC_CELLS:2 * AUC_CELLS]
    n, p = neg.sum(), pos.sum()
    if kind == "logloss" or not n or not p:
        return -row[-1] / max(n + p, 1)
    below = np.cumsum(neg) - neg
    return float((pos * (below + neg / 2)).sum() / (n * p))
