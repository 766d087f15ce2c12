"""A tree as a sequence of balanced parentheses, with a tree of least and greatest excess over blocks of the sequence."""

from __future__ import annotations

import numpy as np

BLOCK = 64


class Parentheses:
    """``bits``: one for an opening, zero for a closing parenthesis of a forest in preorder; memory is a few bytes a bit."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits.astype(bool)
        self.excess = np.cumsum(np.where(self.bits, 1, -1), dtype=np.int32)
        self.opens = np.flatnonzero(self.bits)
        blocks = -(-len(bits) // BLOCK)
        padded = np.concatenate([self.excess, np.repeat(self.excess[-1:], blocks * BLOCK - len(bits))]).reshape(blocks, BLOCK)
        #: (least, greatest) excess of each block, then of each two of them, up to one.
        self.levels = [(padded.min(axis=1), padded.max(axis=1))] if blocks else []
        while self.levels and len(self.levels[-1][0]) > 1:
            low, high = self.levels[-1]
            cut = np.arange(0, len(low), 2)
            self.levels.append((np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))
        pairs = np.zeros(len(bits) + 1, np.int64)
        if len(bits) > 1:
            pairs[1:-1] = np.cumsum(self.bits[:-1] & ~self.bits[1:])
            pairs[-1] = pairs[-2]
        #: Leaves, pairs ``()``, that begin before a position.
        self.pairs = pairs

    def _scan(self, found: np.ndarray, which: np.ndarray, start: np.ndarray, target: np.ndarray) -> None:
        """Puts into ``found[which]`` the first place from ``start`` to the end of its block whose excess is the target."""
        at, end = start.copy(), np.minimum((start // BLOCK + 1) * BLOCK, len(self.bits))
        while len(which):
            inside = at < end
            hit = np.zeros(len(at), bool)
            hit[inside] = self.excess[at[inside]] == target[inside]
            found[which[hit]] = at[hit]
            on = inside & ~hit
            which, at, end, target = which[on], at[on] + 1, end[on], target[on]

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """Position of the parenthesis that closes each of ``opens``: the first after it with an excess one lower."""
        target = self.excess[opens] - 1
        found = np.full(len(opens), -1, np.int64)
        # Places at a block's start have nothing left in the block of the opening one.
        start = opens + 1
        near = np.flatnonzero(start % BLOCK != 0)
        self._scan(found, near, start[near], target[near])
        left = np.flatnonzero(found < 0)
        node, wanted = opens[left] // BLOCK, target[left]
        climbing, at_level = np.arange(len(left)), np.zeros(len(left), np.int64)
        for depth, (low, high) in enumerate(self.levels):
            if not len(climbing):
                break
            here = node[climbing]
            sibling = np.minimum(here + 1, len(low) - 1)
            good = (here % 2 == 0) & (here + 1 < len(low)) & (low[sibling] <= wanted[climbing]) & (wanted[climbing] <= high[sibling])
            node[climbing[good]] += 1
            at_level[climbing[good]] = depth
            climbing = climbing[~good]
            node[climbing] //= 2
        for depth in range(len(self.levels) - 2, -1, -1):
            low, high = self.levels[depth]
            going = np.flatnonzero(at_level > depth)
            child = 2 * node[going]
            first = (low[child] <= wanted[going]) & (wanted[going] <= high[child])
            node[going] = np.where(first, child, child + 1)
            at_level[going] = depth
        self._scan(found, left, node * BLOCK, wanted)
        return found

    def leaves(self, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """Leaf pairs from each opening to its closing parenthesis."""
        return self.pairs[closes] - self.pairs[opens]


def range_min(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Least value of each non-empty range."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    power = np.frexp((stop - start).astype(float))[1] - 1
    out = np.empty(len(start), values.dtype)
    for p, row in enumerate(table):
        of = power == p
        out[of] = np.minimum(row[start[of]], row[stop[of] - (1 << p)])
    return out
