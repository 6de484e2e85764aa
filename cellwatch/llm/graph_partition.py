"""Balanced partitioning of a neighbour graph, and a small classifier that learns it; both on a bounded sample."""

from __future__ import annotations

import numpy as np


def nearest_rows(x: np.ndarray, k: int, step: int = 1024) -> np.ndarray:
    """The k rows of largest inner product with each row, itself left out."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), dtype=np.int64)
    for at in range(0, len(x), step):
        near = x[at : at + step] @ x.T
        near[np.arange(len(near)), at + np.arange(len(near))] = -np.inf
        out[at : at + step] = np.argpartition(-near, k - 1, axis=1)[:, :k] if k else 0
    return out


def _neighbour_sums(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per node the sum of its neighbours' values over the edges (a, b), both ways."""
    n = len(values)
    return np.bincount(a, values[b], n) + np.bincount(b, values[a], n)


def _bisect(n: int, a: np.ndarray, b: np.ndarray, left: int, random: np.random.Generator, rounds: int = 60, passes: int = 20) -> np.ndarray:
    """True for exactly `left` of n nodes, with few edges between the sides.

    The nodes are ordered by the second eigenvector of the normalised graph, by
    power iteration, cut at `left`, and pairs of nodes change sides while that
    lowers the cut.
    """
    degree = np.maximum(1.0, np.bincount(a, minlength=n) + np.bincount(b, minlength=n))
    root = np.sqrt(degree)
    flat = root / np.linalg.norm(root)
    v = random.normal(size=n)
    for _ in range(rounds):
        v -= flat * (flat @ v)
        v /= max(np.linalg.norm(v), 1e-30)
        v += _neighbour_sums(v / root, a, b) / root
    side = np.zeros(n, dtype=bool)
    side[np.argsort(v / root, kind="stable")[:left]] = True
    cut = np.count_nonzero(side[a] != side[b])
    move = max(1, n // 20)
    for _ in range(passes):
        sign = np.where(side, 1.0, -1.0)
        gain = -sign * _neighbour_sums(sign, a, b)
        ours, theirs = np.flatnonzero(side), np.flatnonzero(~side)
        ours = ours[np.argsort(-gain[ours], kind="stable")[:move]]
        theirs = theirs[np.argsort(-gain[theirs], kind="stable")[:move]]
        pairs = min(len(ours), len(theirs))
        pairs = np.count_nonzero(gain[ours[:pairs]] + gain[theirs[:pairs]] > 0)
        if not pairs:
            break
        tried = side.copy()
        tried[ours[:pairs]], tried[theirs[:pairs]] = False, True
        now = np.count_nonzero(tried[a] != tried[b])
        if now < cut:
            side, cut = tried, now
        elif move == 1:
            break
        else:
            move = max(1, move // 2)
    return side


def balanced_parts(neighbours: np.ndarray, parts: int, seed: int = 11) -> np.ndarray:
    """A part for each node of the graph, of sizes that differ by one per level at most, by repeated halving."""
    n = len(neighbours)
    random = np.random.default_rng(seed)
    label = np.zeros(n, dtype=np.int64)
    a, b = np.repeat(np.arange(n), neighbours.shape[1]), neighbours.ravel()
    waiting = [(np.arange(n), 0, parts)]
    while waiting:
        nodes, first, count = waiting.pop()
        if count == 1 or len(nodes) < 2:
            label[nodes] = first
            continue
        place = np.full(n, -1)
        place[nodes] = np.arange(len(nodes))
        inner = (place[a] >= 0) & (place[b] >= 0)
        low = count // 2
        side = _bisect(len(nodes), place[a[inner]], place[b[inner]], round(len(nodes) * low / count), random)
        waiting += [(nodes[side], first, low), (nodes[~side], first + low, count - low)]
    return label


class Router:
    """One hidden layer and a softmax over parts; gives the log-odds of each part."""

    def __init__(self, dimension: int, parts: int, hidden: int = 64, seed: int = 11):
        random = np.random.default_rng(seed)
        self.weights = [random.normal(size=(dimension, hidden)) * np.sqrt(2 / dimension), np.zeros(hidden), random.normal(size=(hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        w, b, u, c = self.weights
        return np.maximum(x @ w + b, 0) @ u + c

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int = 30, batch: int = 256, rate: float = 4e-3, decay: float = 1e-4, seed: int = 11) -> Router:
        """Lower the cross-entropy to the rows of `target`, by Adam."""
        random = np.random.default_rng(seed)
        first, second, step = [0.0] * 4, [0.0] * 4, 0
        for epoch in range(epochs):
            pace = rate * (1 - epoch / epochs)
            order = random.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                w, b, u, c = self.weights
                inner = np.maximum(x[rows] @ w + b, 0)
                odds = inner @ u + c
                odds = np.exp(odds - odds.max(axis=1, keepdims=True))
                wrong = (odds / odds.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
                back = (wrong @ u.T) * (inner > 0)
                step += 1
                for i, g in enumerate((x[rows].T @ back, back.sum(axis=0), inner.T @ wrong, wrong.sum(axis=0))):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    move = first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
                    self.weights[i] = self.weights[i] - pace * (move + decay * self.weights[i])
        return self
