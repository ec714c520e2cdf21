"""Gradient-boosted trees: logistic loss, depth 3, in numpy; fitted on one machine's rows or on those of all."""

from __future__ import annotations

import functools

import numpy as np
from pyspark import RDD, StorageLevel

#: Gradients are summed as integers of this many parts, so their order and the partitions don't matter.
PARTS = 2.0**32


class Boosted:
    """``fit`` on the driver over rows or weighted cells; :func:`fit_blocks` over any number of rows; ``score`` anywhere. Deterministic."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 24, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, cuts: list[np.ndarray] | None = None) -> Boosted:
        x, y = np.asarray(x, float), np.asarray(y, float)
        w = np.ones(len(y)) if weight is None else np.asarray(weight, float)
        mean = np.clip((w * y).sum() / max(w.sum(), 1e-9), 1e-4, 1 - 1e-4) if len(y) else 0.0001
        self.base = float(np.log(mean / (1 - mean)))
        if not len(y) or y.min() == y.max():
            return self
        if cuts is None:
            cuts = [np.unique(np.quantile(c, self.shares())) for c in x.T]
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(x, w * (y - p), w * p * (1 - p), cuts, self.depth)
            self.trees.append(tree)
            f += self.rate * self._walk(tree, x)
        return self

    def shares(self) -> np.ndarray:
        """The shares of the rows below which a column is cut."""
        return np.linspace(0, 1, self.bins + 1)[1:-1]

    def fit_cells(self, codes: np.ndarray, y: np.ndarray, weight: np.ndarray, cuts: list[np.ndarray]) -> Boosted:
        """:meth:`fit` of rows of which only the number in each cell between ``cuts`` is known; nothing else enters the trees."""
        self.fit(codes, y, weight, [np.arange(len(c)) for c in cuts])
        self.trees = [decoded(t, cuts) for t in self.trees]
        return self

    def _grow(self, x, g, h, cuts, depth):
        value = float(g.sum() / (h.sum() + 1.0))
        if depth == 0 or h.sum() < self.least * 0.02:
            return value
        best, total = (1e-6, None, None), g.sum() ** 2 / (h.sum() + 1.0)
        for k, own in enumerate(cuts):
            for c in own:
                left = x[:, k] <= c
                gl, hl = g[left].sum(), h[left].sum()
                gr, hr = g.sum() - gl, h.sum() - hl
                gain = gl * gl / (hl + 1.0) + gr * gr / (hr + 1.0) - total
                if gain > best[0] and left.any() and not left.all():
                    best = (gain, k, c)
        if best[1] is None:
            return value
        left = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[left], g[left], h[left], cuts, depth - 1), self._grow(x[~left], g[~left], h[~left], cuts, depth - 1)

    def _walk(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        left = x[:, tree[0]] <= tree[1]
        out = np.empty(len(x))
        out[left], out[~left] = self._walk(tree[2], x[left]), self._walk(tree[3], x[~left])
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of 1 for each row."""
        x = np.asarray(x, float)
        f = np.full(len(x), self.base)
        for tree in self.trees:
            f += self.rate * self._walk(tree, x)
        return 1 / (1 + np.exp(-f))


def decoded(tree, cuts: list[np.ndarray]):
    """A tree over codes (how many cuts lie below a value) as one over values."""
    if not isinstance(tree, tuple):
        return tree
    k, j, left, right = tree
    return k, float(cuts[k][int(j)]), decoded(left, cuts), decoded(right, cuts)


def _nested(node: int, splits: dict[int, tuple[int, int]], leaf):
    """The tree whose inner nodes are ``splits``; children of node i are 2 i + 1 and 2 i + 2."""
    return (*splits[node], _nested(2 * node + 1, splits, leaf), _nested(2 * node + 2, splits, leaf)) if node in splits else leaf(node)


def _sums(block, shapes: dict[str, tuple], bins: int) -> dict[str, np.ndarray]:
    """For the open nodes of the block's kind [node, column, code, (gradient, its slope, rows)], as integers."""
    kind, codes, y, f = block
    shape, nodes = shapes[kind]
    if not nodes:
        return {}
    p = 1 / (1 + np.exp(-f))
    node = Boosted()._walk(shape, codes).astype(np.int64)
    own = node >= 0
    parts = np.rint((y - p)[own] * PARTS), np.rint((p * (1 - p))[own] * PARTS), np.ones(int(own.sum()))
    out = np.zeros((nodes, codes.shape[1], bins, 3), np.int64)
    for k in range(codes.shape[1]):
        cell = node[own] * bins + codes[own, k]
        for c, w in enumerate(parts):  # exact: a block has less than 2 ** 21 rows
            out[:, k, :, c] = np.bincount(cell, w, nodes * bins).astype(np.int64).reshape(nodes, bins)
    return {kind: out}


def _add(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: a[k] + b[k] if k in a and k in b else a.get(k, b.get(k)) for k in {*a, *b}}


def _step(block, trees: dict[str, tuple], rate: float):
    kind, codes, y, f = block
    return kind, codes, y, f + rate * Boosted()._walk(trees[kind], codes) if kind in trees else f


def _split(sums: np.ndarray, cuts: list[np.ndarray], least: float):
    """(value, split or None, values of the two children) of a node."""
    g, h = sums[..., 0] / PARTS, sums[..., 1] / PARTS
    total, slope, rows = g[0].sum(), h[0].sum(), sums[0, :, 2].sum()
    value = float(total / (slope + 1.0))
    if slope < least * 0.02:
        return value, None, None
    gl, hl, nl = (np.cumsum(sums[..., c], 1) for c in range(3))
    gl, hl = gl / PARTS, hl / PARTS
    gain = gl * gl / (hl + 1.0) + (total - gl) ** 2 / (slope - hl + 1.0) - total**2 / (slope + 1.0)
    able = (nl > 0) & (nl < rows) & (np.arange(sums.shape[1]) < np.array([len(c) for c in cuts])[:, None])
    gain = np.where(able, gain, -np.inf)
    k, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if gain[k, j] <= 1e-6:
        return value, None, None
    return value, (int(k), int(j)), (float(gl[k, j] / (hl[k, j] + 1.0)), float((total - gl[k, j]) / (slope - hl[k, j] + 1.0)))


def fit_blocks(blocks: RDD, cuts: dict[str, list[np.ndarray]], totals: dict[str, tuple[int, int]]) -> dict[str, Boosted]:
    """A model for each kind from all rows, wherever they are.

    ``blocks``: (kind, codes, y) of less than 2 ** 21 rows each; codes [row,
    column] say how many of the column's ``cuts`` lie below the value.
    ``totals``: rows and ones of each kind. Only the sums of the nodes' cells
    come to the driver, a level of all kinds' trees at a time.
    """
    models = {kind: Boosted() for kind in cuts}
    for kind, (n, ones) in totals.items():
        mean = np.clip(ones / max(n, 1), 1e-4, 1 - 1e-4)
        models[kind].base = float(np.log(mean / (1 - mean)))
    growing = {kind for kind, (n, ones) in totals.items() if 0 < ones < n}
    base = {kind: m.base for kind, m in models.items()}
    first = Boosted()
    state = blocks.map(lambda b: (b[0], b[1], b[2], np.full(len(b[2]), base[b[0]]))).persist(StorageLevel.MEMORY_AND_DISK)
    stale = None
    for _ in range(first.rounds if growing else 0):
        splits: dict[str, dict] = {kind: {} for kind in growing}
        values: dict[str, dict] = {kind: {} for kind in growing}
        open_ = {kind: [0] for kind in growing}
        for _level in range(first.depth):
            shapes = {kind: (_nested(0, splits[kind], lambda i, o=own: float(o.index(i)) if i in o else -1.0), len(own)) for kind, own in open_.items()}
            shapes.update({kind: (-1.0, 0) for kind in models if kind not in growing})
            sums = state.map(functools.partial(_sums, shapes=shapes, bins=first.bins)).reduce(_add)
            if stale is not None:  # its successor is held by now
                stale.unpersist()
                stale = None
            for kind, own in open_.items():
                nodes, open_[kind] = own, []
                for at, node in enumerate(nodes):
                    values[kind][node], split, below = _split(sums[kind][at], cuts[kind], first.least)
                    if split is not None:
                        splits[kind][node] = split
                        values[kind][2 * node + 1], values[kind][2 * node + 2] = below
                        open_[kind] += [2 * node + 1, 2 * node + 2]
            if not any(open_.values()):
                break
        trees = {kind: _nested(0, splits[kind], values[kind].get) for kind in growing}
        for kind, tree in trees.items():
            models[kind].trees.append(decoded(tree, cuts[kind]))
        before, state = state, state.map(functools.partial(_step, trees=trees, rate=first.rate)).persist(StorageLevel.MEMORY_AND_DISK)
        stale = before
    for rows in (stale, state):
        if rows is not None:
            rows.unpersist()
    return models
