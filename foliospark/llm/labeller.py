"""A bidirectional LSTM in numpy that gives every leaf of a text its family.

It reads, leaf by leaf and in both directions, the leaf's tag path and hashed words,
over all blocks of a page in their order, so a shape that can mean several things is
decided by the whole page around it. Nothing is cut off: every word of a leaf, the
whole path, and every leaf of a page, however long, is read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache
from pathlib import Path
from zlib import crc32

import numpy as np

from foliospark.llm.leaves import ALLOWED, FAMILIES, KINDS, Leaf, Open, leaves_of

#: Widths of the hashed tag path, the hashed words and the state of each direction.
PATH, WORD, HIDDEN = 12, 16, 20
SHAPE = 11
INPUT = len(KINDS) + PATH + WORD + SHAPE
#: How much each further element outward counts in the path.
OUTWARD = 0.6
#: Leaves (padding included) in one batch of pages.
CELLS = 60_000
WEIGHTS = Path(__file__).with_name("labeller.npz")

_WORDS = re.compile(r"[^\W\d_]+|\d+|\\[A-Za-z]+")
_SIGNS = frozenset("=+^\\{")
_AT = {k: i for i, k in enumerate(KINDS)}
#: Families of each kind as indices, none first.
_MAY = {k: (0, *(FAMILIES.index(f) for f in may)) for k, may in ALLOWED.items()}


@lru_cache(maxsize=100_000)
def _slot(word: str, width: int) -> tuple[int, float]:
    h = crc32(word.encode())
    return h % width, 1.0 if h & 0x10000 else -1.0


def _path(held: dict[int, np.ndarray], node: Open) -> np.ndarray:
    """The hashed path of an open element; each element's vector is its own and, weaker, that of what is around it."""
    if node.around is None:
        return _outer(node.name)
    todo = []
    while node.around is not None and id(node) not in held:
        todo.append(node)
        node = node.around
    vector = held[id(node)] if id(node) in held else _outer(node.name)
    for n in reversed(todo):
        vector = OUTWARD * np.concatenate([vector[-1:], vector[:-1]])
        k, sign = _slot(n.name, PATH)
        vector[k] += sign
        held[id(n)] = vector
    return vector


@lru_cache(maxsize=10_000)
def _outer(name: str) -> np.ndarray:
    """The path of an element that nothing is open around."""
    vector = np.zeros(PATH, np.float32)
    k, sign = _slot(name, PATH)
    vector[k] = sign
    return vector


def features(text: str, leaves: Sequence[Leaf]) -> np.ndarray:
    """One row per leaf of one block: its kind, tag path, words and shape."""
    out = np.zeros((len(leaves), INPUT), np.float32)
    p0, w0, s0 = len(KINDS), len(KINDS) + PATH, len(KINDS) + PATH + WORD
    held: dict[int, np.ndarray] = {}
    for i, leaf in enumerate(leaves):
        row, part = out[i], text[leaf.start : leaf.end]
        row[_AT[leaf.kind]] = 1
        if leaf.path is not None:
            row[p0:w0] = _path(held, leaf.path)
        words = _WORDS.findall(part.lower())
        if words:
            total = [0.0] * WORD
            for word in words:
                k, sign = _slot(word, WORD)
                total[k] += sign
            row[w0:s0] = total
            row[w0:s0] /= (1 + len(words)) ** 0.5
        before = text[leaf.start - 1] if leaf.start else "\n"
        after = text[leaf.end] if leaf.end < len(text) else "\n"
        inner = part.strip("$*_~'`=#[]{}|<> \n")
        row[s0 : s0 + SHAPE] = (
            before.isalnum(), after.isalnum(), before == "\n", after == "\n", before == ":", inner[:1].isdigit(),
            not _SIGNS.isdisjoint(inner), " " in inner, not words, i == 0, inner.count(" ") / (1 + len(inner)) * 5,
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Labeller:
    """Weights and the two passes; ``train_batch`` is the gradient of a batch."""

    NAMES = ("wf", "uf", "bf", "wb", "ub", "bb", "wo", "bo")

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        h, d, n = HIDDEN, INPUT, len(FAMILIES)
        draw = lambda a, b: (rng.standard_normal((a, b)) / a**0.5).astype(np.float32)
        self.w = weights or {
            "wf": draw(d, 4 * h), "uf": draw(h, 4 * h), "bf": np.zeros(4 * h, np.float32),
            "wb": draw(d, 4 * h), "ub": draw(h, 4 * h), "bb": np.zeros(4 * h, np.float32),
            "wo": draw(2 * h + d, n), "bo": np.zeros(n, np.float32),
        }

    @classmethod
    def load(cls) -> "Labeller":
        """The trained weights that come with the package (made by ``markup_train``)."""
        with np.load(WEIGHTS) as held:
            return cls({k: held[k].astype(np.float32) for k in cls.NAMES})

    def _pass(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool = False):
        """States of one direction; x is (time, batch, input), mask (time, batch, 1)."""
        t, b, _ = x.shape
        h = HIDDEN
        u = self.w["u" + side]
        pre = (x.reshape(t * b, -1) @ self.w["w" + side] + self.w["b" + side]).reshape(t, b, 4 * h)
        state, cell = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
        out = np.zeros((t, b, h), np.float32)
        trace = [None] * t
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            g = pre[k] + state @ u
            gates = _sigmoid(g[:, : 3 * h])
            new = np.tanh(g[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            c = (f * cell + i * new) * mask[k]
            squashed = np.tanh(c)
            if keep:
                trace[k] = (state, cell, i, f, o, new, squashed)
            state, cell = o * squashed * mask[k], c
            out[k] = state
        return out, trace

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(time, batch, family) scores."""
        f, _ = self._pass(x, mask, "f")
        b, _ = self._pass(x, mask, "b")
        return np.concatenate([f, b, x], 2) @ self.w["wo"] + self.w["bo"]

    def train_batch(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the leaves and its gradient."""
        f, tf = self._pass(x, mask, "f", True)
        b, tb = self._pass(x, mask, "b", True)
        joined = np.concatenate([f, b, x], 2)
        score = joined @ self.w["wo"] + self.w["bo"]
        score -= score.max(2, keepdims=True)
        p = np.exp(score)
        p /= p.sum(2, keepdims=True)
        n = max(mask.sum(), 1)
        rows = np.take_along_axis(p, y[:, :, None], 2)
        loss = float(-(np.log(rows + 1e-9) * mask).sum() / n)
        error = p
        np.put_along_axis(error, y[:, :, None], rows - 1, 2)
        error = error * mask / n
        flat = error.reshape(-1, error.shape[2])
        grad = {"wo": joined.reshape(-1, joined.shape[2]).T @ flat, "bo": flat.sum(0)}
        back = error @ self.w["wo"].T
        h = HIDDEN
        for side, trace, d_out in (("f", tf, back[:, :, :h]), ("b", tb, back[:, :, h : 2 * h])):
            t = x.shape[0]
            u = self.w["u" + side]
            d_state, d_cell = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
            d_pre = np.zeros((t, x.shape[1], 4 * h), np.float32)
            g_u = np.zeros_like(u)
            for k in range(t - 1, -1, -1) if side == "f" else range(t):
                state, cell, i, fg, o, new, squashed = trace[k]
                d_h = (d_out[k] + d_state) * mask[k]
                d_c = (d_h * o * (1 - squashed**2) + d_cell) * mask[k]
                d = np.concatenate([d_c * new * i * (1 - i), d_c * cell * fg * (1 - fg), d_h * squashed * o * (1 - o), d_c * i * (1 - new**2)], 1)
                d_pre[k] = d
                g_u += state.T @ d
                d_state, d_cell = d @ u.T, d_c * fg
            flat_d = d_pre.reshape(-1, 4 * h)
            grad |= {"w" + side: x.reshape(-1, x.shape[2]).T @ flat_d, "u" + side: g_u, "b" + side: flat_d.sum(0)}
        return loss, grad

    def label(self, pages: Sequence[Sequence[str]]) -> list[list[tuple[list[Leaf], np.ndarray]]]:
        """For each page (its blocks' texts in order) and block: the leaves and their families (indices of ``FAMILIES``).

        A leaf gets the family of the best score among those its shape can have and
        none. Pages of like length share a batch; a page is one sequence, whatever its length.
        """
        found = [[leaves_of(t) for t in page] for page in pages]
        out = [[np.zeros(len(leaves), np.int8) for leaves in page] for page in found]
        jobs = []
        for i, page in enumerate(found):
            if any(ALLOWED[leaf.kind] for leaves in page for leaf in leaves):
                jobs.append((sum(map(len, page)), i))
        jobs.sort(reverse=True)
        while jobs:
            size = max(1, CELLS // jobs[0][0])
            part, jobs = jobs[:size], jobs[size:]
            x = np.zeros((part[0][0], len(part), INPUT), np.float32)
            mask = np.zeros((part[0][0], len(part), 1), np.float32)
            for k, (n, i) in enumerate(part):
                x[:n, k] = np.concatenate([features(t, leaves) for t, leaves in zip(pages[i], found[i])])
                mask[:n, k] = 1
            score = self.scores(x, mask)
            for k, (_, i) in enumerate(part):
                t = 0
                for leaves, families in zip(found[i], out[i]):
                    for j, leaf in enumerate(leaves):
                        may = _MAY[leaf.kind]
                        if len(may) > 1:
                            families[j] = max(may, key=score[t, k].__getitem__)
                        t += 1
        return [list(zip(page, families)) for page, families in zip(found, out)]
