"""Learned partitions of a vector space, fitted on a bounded sample with numpy.

The sample's neighbour graph is cut into balanced parts by size-constrained label
propagation, and a softmax classifier learns which parts a vector's neighbours lie
in; it then places every vector and routes every query to its most probable parts.
A router may have children, one per part, each fitted on a sample of its part: the
parts of the children are then the parts, so their number grows with the data while
every fit stays bounded.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Neighbours in the graph; how far a part may exceed the mean size.
GRAPH_K, SLACK = 10, 1.1


def neighbour_graph(x: np.ndarray, k: int = GRAPH_K) -> np.ndarray:
    """Indices of the k most similar others of each row (rows are of unit length)."""
    n = len(x)
    out = np.empty((n, min(k, n - 1)), np.int32)
    for a in range(0, n, 1024):
        like = x[a : a + 1024] @ x.T
        like[np.arange(len(like)), np.arange(a, a + len(like))] = -2
        out[a : a + 1024] = np.argpartition(-like, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def _assign(score: np.ndarray, room: int) -> np.ndarray:
    """Each row to its best column, no column beyond ``room``; the surest rows choose first."""
    n, m = score.shape
    label = np.full(n, -1, np.int32)
    left = np.full(m, room)
    open_ = np.ones(m, bool)
    rows = np.arange(n)
    while len(rows):
        part = np.where(open_, score[rows], -np.inf)
        want = part.argmax(1)
        value = part[np.arange(len(rows)), want]
        order = np.lexsort((-value, want))
        ranked = want[order]
        place = np.arange(len(order)) - np.searchsorted(ranked, ranked)
        ok = order[place < left[ranked]]
        label[rows[ok]] = want[ok]
        left -= np.bincount(want[ok], minlength=m)
        open_ = left > 0
        rows = rows[label[rows] < 0]
    return label


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Part of each row: the graph cut into ``parts`` parts of nearly equal size with few edges between.

    Starts from balanced spherical means, then moves rows to the part most of their
    neighbours (in either direction) lie in, as far as sizes allow.
    """
    n = len(x)
    room = int(np.ceil(n / parts * SLACK))
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(n, parts, replace=False)]
    for _ in range(6):
        label = _assign(x @ centre.T, room)
        total = np.zeros((parts, x.shape[1]), x.dtype)
        np.add.at(total, label, x)
        centre = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    source = np.repeat(np.arange(n), graph.shape[1])
    target = graph.ravel()
    affinity = x @ centre.T
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.float32)
        np.add.at(votes, (source, label[target]), 1)
        np.add.at(votes, (target, label[source]), 1)
        moved = _assign(votes + 0.5 * (np.arange(parts) == label[:, None]) + 0.1 * affinity, room)
        same = (moved == label).mean()
        label = moved
        if same > 0.995:
            break
    return label


def _best(score: np.ndarray, top: int) -> np.ndarray:
    """Columns of the ``top`` largest scores of each row, largest first."""
    best = np.argpartition(-score, top - 1, axis=1)[:, :top]
    return np.take_along_axis(best, np.argsort(-np.take_along_axis(score, best, 1), axis=1, kind="stable"), 1)


class Router(NamedTuple):
    """A one-layer softmax classifier; one part needs no weights."""

    weight: np.ndarray | None
    bias: np.ndarray | None
    own: int
    children: "tuple[Router, ...] | None" = None

    @property
    def parts(self) -> int:
        """Number of parts, of the children where there are any."""
        return self.own if self.children is None else sum(c.parts for c in self.children)

    def _log(self, x: np.ndarray) -> np.ndarray:
        if self.weight is None:
            return np.zeros((len(x), 1), np.float32)
        score = x @ self.weight + self.bias
        score -= score.max(1, keepdims=True)
        return score - np.log(np.exp(score).sum(1, keepdims=True))

    def rank(self, x: np.ndarray, top: int) -> np.ndarray:
        """The ``top`` most probable parts of each row, best first.

        With children a part's probability is that of its parent times its own; as many
        parents are looked into as could hold the answer, and one more.
        """
        top = min(top, self.parts)
        score = self._log(x)
        if self.children is None:
            return _best(score, top)
        parents = _best(score, min(self.own, top + 1))
        wide = parents.shape[1]
        start = np.cumsum([0, *(c.parts for c in self.children)])
        part = np.full((len(x), wide * top), -1, np.int64)
        value = np.full((len(x), wide * top), -np.inf, np.float32)
        for j in np.unique(parents):
            rows, slot = np.nonzero(parents == j)
            own = self.children[j]._log(x[rows])
            best = _best(own, min(top, own.shape[1]))
            at = slot[:, None] * top + np.arange(best.shape[1])
            part[rows[:, None], at] = start[j] + best
            value[rows[:, None], at] = score[rows, j][:, None] + np.take_along_axis(own, best, 1)
        return np.take_along_axis(part, _best(value, top), 1)


def fit_router(x: np.ndarray, parts: int, epochs: int = 20, seed: int = 7) -> Router:
    """Graph, balanced parts and classifier of a sample of unit vectors."""
    parts = max(1, min(parts, len(x) // 20))
    if parts == 1:
        return Router(None, None, 1)
    graph = neighbour_graph(x)
    label = balanced_parts(x, graph, parts)
    # What the classifier shall give: the share of a row's neighbours, itself included, in each part.
    goal = np.zeros((len(x), parts), np.float32)
    np.add.at(goal, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph.ravel()]), 1)
    goal[np.arange(len(x)), label] += 2
    goal /= goal.sum(1, keepdims=True)
    rng = np.random.default_rng(seed)
    centre = np.zeros((parts, x.shape[1]), np.float32)
    np.add.at(centre, label, x)
    weight = (8 * centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)).T.copy()
    bias = np.zeros(parts, np.float32)
    m_w, v_w, m_b, v_b = np.zeros_like(weight), np.zeros_like(weight), np.zeros_like(bias), np.zeros_like(bias)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 512):
            rows = order[a : a + 512]
            score = x[rows] @ weight + bias
            score -= score.max(1, keepdims=True)
            p = np.exp(score)
            p /= p.sum(1, keepdims=True)
            error = (p - goal[rows]) / len(rows)
            g_w, g_b = x[rows].T @ error + 1e-5 * weight, error.sum(0)
            step += 1
            for value, grad, m, v in ((weight, g_w, m_w, v_w), (bias, g_b, m_b, v_b)):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Router(weight.astype(np.float32), bias, parts)
