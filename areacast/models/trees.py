"""Growing and reading many binary trees at once, on weighted rows in numpy.

All trees of a call grow together, level by level: a level is a few sorts and sums over
the rows that are still in open nodes, whatever the number of trees.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(h: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def root_paths(trees: np.ndarray, seed: int) -> np.ndarray:
    """What names the root of each tree; a node's name decides which terms it tries."""
    return mixed(np.asarray(trees, np.uint64) * _ODD + np.uint64(seed & (2**63 - 1)))


def child_paths(paths: np.ndarray) -> np.ndarray:
    """Names of the left and right children, side by side."""
    sides = np.array([1, 2], np.uint64)
    return mixed(paths[:, None] * _ODD + sides).ravel()


def tried_terms(paths: np.ndarray, terms: int, tried: int) -> np.ndarray:
    """The terms that each node tries, in order."""
    keys = mixed(paths[:, None] + np.arange(1, terms + 1, dtype=np.uint64) * _ODD)
    return np.sort(np.argsort(keys, axis=1, kind="stable")[:, :tried], axis=1)


def poisson_draws(key: int, stream: int, mean: float, trees: int) -> np.ndarray:
    """How often a cell's respondents of one outcome are drawn for each tree.

    The number belongs to the cell and the stream, so it is the same in any task.
    """
    if mean <= 0:
        return np.zeros(trees)
    state = np.random.Philox(key=[key & (2**64 - 1), stream & (2**64 - 1)])
    return np.random.Generator(state).poisson(mean, trees).astype(float)


@dataclass
class Trees:
    """Nodes of several trees.  The right child follows the left; a leaf has term -1."""

    term: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    def leaves(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The leaf under node ``at`` that each row of ``x`` falls into."""
        at = at.copy()
        live = np.flatnonzero(self.term[at] >= 0)
        while len(live):
            node = at[live]
            at[live] = self.left[node] + (x[live, self.term[node]] > self.cut[node])
            live = live[self.term[at[live]] >= 0]
        return at

    def total(self, x: np.ndarray) -> np.ndarray:
        """Sum of the trees' values for each row."""
        out = np.empty(len(x))
        step = max(1, 2_000_000 // max(1, len(self.roots)))
        for start in range(0, len(x), step):
            rows = x[start : start + step]
            spread = np.repeat(np.arange(len(rows)), len(self.roots))
            at = self.leaves(rows[spread], np.tile(self.roots, len(rows)))
            out[start : start + step] = self.value[at].reshape(len(rows), -1).sum(axis=1)
        return out

    def _owners(self) -> np.ndarray:
        """The tree of each node, found level by level from the roots; -1 without one."""
        owner = np.full(len(self.term), -1)
        owner[self.roots] = np.arange(len(self.roots))
        level = self.roots
        while len(level):
            level = level[self.term[level] >= 0]
            left = self.left[level]
            owner[left] = owner[left + 1] = owner[level]
            level = np.concatenate([left, left + 1])
        return owner

    def sizes(self) -> np.ndarray:
        """Nodes of each tree."""
        owner = self._owners()
        return np.bincount(owner[owner >= 0], minlength=len(self.roots))

    def some(self, trees: np.ndarray) -> Trees:
        """The given trees, without the nodes of others."""
        picked = Trees(self.term, self.cut, self.left, self.value, self.roots[trees])
        mine = np.flatnonzero(picked._owners() >= 0)
        place = np.full(len(self.term), -1)
        place[mine] = np.arange(len(mine))
        left = np.where(self.term[mine] >= 0, place[self.left[mine]], -1)
        return Trees(self.term[mine], self.cut[mine], left, self.value[mine], place[picked.roots])

    @classmethod
    def joined(cls, parts: Sequence[Trees]) -> Trees:
        skip = np.cumsum([0, *[len(p.term) for p in parts]])
        return cls(
            np.concatenate([p.term for p in parts]),
            np.concatenate([p.cut for p in parts]),
            np.concatenate([np.where(p.term >= 0, p.left + s, -1) for p, s in zip(parts, skip)]),
            np.concatenate([p.value for p in parts]),
            np.concatenate([p.roots + s for p, s in zip(parts, skip)]),
        )


def best_cuts(x, w, s, node, weight, hits, terms):
    """Per node the term and cut that leave the least squared error; term -1 if none.

    Of equal ones the first term and the lowest cut count.
    """
    nodes = len(weight)
    score, term, cut = np.full(nodes, -np.inf), np.full(nodes, -1), np.zeros(nodes)
    for j in range(terms.shape[1]):
        value = x[np.arange(len(x)), terms[node, j]]
        order = np.lexsort((value, node))
        n, v = node[order], value[order]
        first = np.flatnonzero(np.append(True, (n[1:] != n[:-1]) | (v[1:] != v[:-1])))
        n, v = n[first], v[first]
        # Sums up to and with each value, from the start of its node on.
        up_w = np.cumsum(np.add.reduceat(w[order], first))
        up_s = np.cumsum(np.add.reduceat(s[order], first))
        start = np.searchsorted(n, np.arange(nodes))
        before_w, before_s = np.append(0.0, up_w)[start], np.append(0.0, up_s)[start]
        at = np.flatnonzero(n[1:] == n[:-1])
        if not len(at):
            continue
        m = n[at]
        left_w, left_s = up_w[at] - before_w[m], up_s[at] - before_s[m]
        right_w, right_s = weight[m] - left_w, hits[m] - left_s
        gain = left_s * left_s / left_w + right_s * right_s / right_w
        runs = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
        top = np.maximum.reduceat(gain, runs)
        owner = m[runs]
        top_of = np.full(nodes, np.inf)
        top_of[owner] = top
        hit = np.flatnonzero(gain == top_of[m])
        hit = hit[np.append(True, m[hit][1:] != m[hit][:-1])]
        better = hit[gain[hit] > score[m[hit]]]
        who = m[better]
        score[who], term[who] = gain[better], terms[who, j]
        cut[who] = middle(v[at[better]], v[at[better] + 1])
    return term, cut


def middle(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A cut between two values; rows above it go to the right."""
    half = (low + high) / 2
    return np.where(half < high, half, low)


def grow(x, w, s, group, paths, tried, min_node, max_depth, depths=None) -> Trees:
    """One tree per group from rows ``x`` of weight ``w`` with ``s`` hits.

    ``paths`` and ``depths`` are those of the groups' roots.  A node is a leaf if its rows
    agree, its weight is at most ``min_node``, it is ``max_depth`` deep, or the terms it
    tries are constant.
    """
    kept = w > 0
    x, w, s, node = x[kept], w[kept], s[kept], np.asarray(group)[kept]
    depth = np.zeros(len(paths), int) if depths is None else np.asarray(depths)
    parts, base, roots = [], 0, np.arange(len(paths))
    while len(paths):
        m = len(paths)
        weight, hits = np.bincount(node, w, m), np.bincount(node, s, m)
        value = np.divide(hits, weight, out=np.full(m, np.nan), where=weight > 0)
        term, cut, left = np.full(m, -1), np.zeros(m), np.full(m, -1)
        open_ = (hits > 0) & (hits < weight) & (weight > min_node) & (depth < max_depth)
        now = np.flatnonzero(open_)
        place = np.full(m, -1)
        place[now] = np.arange(len(now))
        inside = open_[node]
        x, w, s, node = x[inside], w[inside], s[inside], place[node[inside]]
        if len(now):
            terms = tried_terms(paths[now], x.shape[1], tried)
            best, at = best_cuts(x, w, s, node, weight[now], hits[now], terms)
            split = np.flatnonzero(best >= 0)
            term[now[split]], cut[now[split]] = best[split], at[split]
            left[now[split]] = base + m + 2 * np.arange(len(split))
            place = np.full(len(now), -1)
            place[split] = np.arange(len(split))
            inside = best[node] >= 0
            x, w, s, node = x[inside], w[inside], s[inside], node[inside]
            right = x[np.arange(len(x)), best[node]] > at[node]
            node = 2 * place[node] + right
            paths, depth = child_paths(paths[now[split]]), np.repeat(depth[now[split]] + 1, 2)
        else:
            paths = paths[:0]
        parts.append((term, cut, left, value))
        base += m
    term, cut, left, value = (np.concatenate(c) for c in zip(*parts)) if parts else [np.zeros(0)] * 4
    return Trees(term.astype(np.int16), cut, left.astype(np.int32), value, roots)
