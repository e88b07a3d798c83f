"""A binary trie over sorted keys, joined with itself under an error budget.

A node is a range of the sorted keys that agree on their first bits; nothing else is built. The walk holds pairs of
nodes. For each pair it goes down to where the first of the two forks, counts the bits in which the paths differ
until there, drops the pair once they are over the budget, and else goes on with the pairs of their children. Pairs
of nodes with a few keys are compared outright. Many pairs are walked at once, but depth-first: at most CHUNK of them
are opened together and the others wait, so that memory is bounded by the depth and not by the number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BITS = 64
#: Node pairs of so many key pairs at most are compared outright; node pairs opened together; comparisons at once.
LEAF, CHUNK, AT_ONCE = 16, 1 << 15, 1 << 19


def bit_length(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for by in (1, 2, 4, 8, 16, 32):
        x |= x >> np.uint64(by)
    return np.bitwise_count(x).astype(np.int64)


def close_pairs(keys: np.ndarray, top: int, budget: int, bits: int = BITS, leaf: int = LEAF, told: dict[str, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of sorted keys that agree on their first `top` bits (1 or more) and differ in `budget` of the leading `bits` at most.

    told counts the node pairs that were opened, dropped and compared.
    """
    head = keys >> np.uint64(BITS - top)
    lo = np.flatnonzero(np.r_[True, head[1:] != head[:-1]]) if len(keys) else np.zeros(0, np.int64)
    hi = np.r_[lo[1:], len(keys)]
    many = hi - lo > 1
    waiting = [(lo[many], hi[many], lo[many], hi[many])]
    while waiting:
        front = waiting.pop()
        if len(front[0]) > CHUNK:
            waiting.append(tuple(x[CHUNK:] for x in front))
            front = tuple(x[:CHUNK] for x in front)
        a0, a1, b0, b1 = front
        if not len(a0):
            continue
        forks = np.maximum(bit_length(keys[a0] ^ keys[a1 - 1]), bit_length(keys[b0] ^ keys[b1 - 1]))
        depth = np.minimum(BITS - forks, bits)
        differ = np.bitwise_count((keys[a0] ^ keys[b0]) >> (BITS - depth).astype(np.uint64))
        near = differ <= budget
        small = near & (((a1 - a0) * (b1 - b0) <= leaf) | (depth == bits))
        on = near & ~small
        if told is not None:
            for name, n in (("opened", on.sum()), ("dropped", (~near).sum()), ("compared", small.sum())):
                told[name] = told.get(name, 0) + int(n)
        yield from _compare(keys, a0[small], a1[small], b0[small], b1[small], budget, bits)
        a0, a1, b0, b1, depth = (x[on] for x in (a0, a1, b0, b1, depth))
        bit = np.uint64(1) << (BITS - 1 - depth).astype(np.uint64)
        path = ~((bit << np.uint64(1)) - np.uint64(1))
        am, bm = (np.searchsorted(keys, (keys[x] & path) | bit) for x in (a0, b0))
        other = a0 != b0  # a node with itself has its two children together once
        children = [(a0, am, b0, bm), (am, a1, bm, b1), (a0, am, bm, b1), tuple(x[other] for x in (am, a1, b0, bm))]
        a0, a1, b0, b1 = (np.concatenate(x) for x in zip(*children, strict=True))
        alive = (a0 < a1) & (b0 < b1) & ~((a0 == b0) & (a1 - a0 < 2))
        waiting.append((a0[alive], a1[alive], b0[alive], b1[alive]))


def _compare(keys: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, budget: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every key of a pair's first node with those of its second, about AT_ONCE comparisons at a time."""
    n = a1 - a0
    i = np.repeat(a0, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    lo, hi = np.maximum(np.repeat(b0, n), i + 1), np.repeat(b1, n)
    some = lo < hi
    i, lo, width = i[some], lo[some], (hi - lo)[some]
    ends = np.cumsum(width)
    start = 0
    while start < len(i):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + AT_ONCE, "right")))
        w = width[start:stop]
        left = np.repeat(i[start:stop], w)
        right = np.repeat(lo[start:stop], w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        near = np.bitwise_count((keys[left] ^ keys[right]) >> np.uint64(BITS - bits)) <= budget
        if near.any():
            yield left[near], right[near]
        start = stop
