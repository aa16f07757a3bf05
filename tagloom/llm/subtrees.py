"""Suffix trees of groups of suffixes that share a prefix, and their deep internal nodes.

A tree is kept as the sorted suffixes and the depths at which neighbours part (its internal nodes are the intervals of that
list). Sorting is by prefixes of 1, 2, 4 ... words; the ranks of each length stay, so that the depth at which two
neighbours part is found by the same lengths downwards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Subtree:
    """leaves: suffix starts in order; depth[i]: words shared by leaves i - 1 and i, up to the depth that was asked for."""

    leaves: np.ndarray
    depth: np.ndarray

    def nodes(self, least: int) -> np.ndarray:
        """For each leaf the number of the topmost node of at least that depth above it (a leaf alone has its own)."""
        return np.cumsum(np.append(True, self.depth[1:] < least)[: len(self.leaves)])

    def maximal_repeats(self, least: int) -> list[tuple[int, int, int]]:
        """(first leaf, last leaf, depth) of every internal node at least that deep."""
        found, stack = [], []
        for i, d in enumerate([*self.depth[1:].tolist(), 0], 1):
            left = i - 1
            while stack and stack[-1][1] > d:
                left, deep = stack.pop()
                if deep >= least:
                    found.append((left, i - 1, deep))
            if d and (not stack or stack[-1][1] < d):
                stack.append((left, d))
        return found


def subtree(tokens: np.ndarray, suffixes: np.ndarray, room: np.ndarray, depth: int) -> Subtree:
    """The tree of the given suffixes of a token sequence down to `depth`; room: words up to the end of each suffix's text."""
    if not len(suffixes):
        return Subtree(suffixes, np.zeros(0, np.int64))
    n = len(tokens)
    ranks = [np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1]
    length = 1
    while length * 2 <= depth:
        after = np.zeros(n, np.int64)
        after[: n - length] = ranks[-1][length:] if length < n else 0
        pair = ranks[-1] * (n + 2) + after
        ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int64) + 1)
        length *= 2
    top = ranks[-1]
    keys, at, left = [], suffixes, np.minimum(room, depth)
    for rank, size in zip(reversed(ranks), (1 << i for i in range(len(ranks) - 1, -1, -1)), strict=True):
        while (fits := left >= size).any():
            keys.append(np.where(fits, rank[np.minimum(at, n - 1)], 0))
            at = at + np.where(fits, size, 0)
            left = left - np.where(fits, size, 0)
            if size < length:
                break
    assert len(top) == n
    order = np.lexsort(keys[::-1])
    leaves, spare = suffixes[order], np.minimum(room, depth)[order]
    shared = np.zeros(len(leaves), np.int64)
    a, b = leaves[:-1].copy(), leaves[1:].copy()
    left = np.minimum(spare[:-1], spare[1:])
    found = np.zeros(len(a), np.int64)
    for rank, size in zip(reversed(ranks), (1 << i for i in range(len(ranks) - 1, -1, -1)), strict=True):
        for _ in range(2 if size == length else 1):
            fits = np.flatnonzero(left - found >= size)
            fits = fits[rank[a[fits] + found[fits]] == rank[b[fits] + found[fits]]]
            found[fits] += size
    shared[1:] = found
    return Subtree(leaves, shared)
