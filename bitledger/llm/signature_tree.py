"""Signature trees over sets: bitmaps joined upwards, and the dual traversal of two trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FANOUT = 8
MIN_BITS, MAX_BITS = 256, 1 << 14
# Bitmap words compared at once.
_WORDS_AT_ONCE = 1 << 20


class Sets:
    """Sets of sorted int64 elements. ``sizes`` may count elements that no other set holds
    and that are left out of ``elements``."""

    def __init__(self, sizes: np.ndarray, elements: list[np.ndarray]):
        self.sizes, self.elements = sizes.astype(np.int64), elements

    def __len__(self) -> int:
        return len(self.elements)


class Tree:
    """Levels from single sets (0) to one root: OR-combined bitmaps, size ranges, and the most
    elements that a set has beyond its bits."""

    def __init__(self, sets: Sets, bits: int):
        self.order = np.lexsort(([e[0] if len(e) else 0 for e in sets.elements], sets.sizes))
        ordered = [sets.elements[k] for k in self.order]
        lengths = np.array([len(e) for e in ordered], np.int64)
        words = bits // 64
        bitmap = np.empty((len(ordered), words), np.uint64)
        # A limited number of sets at a time, since one bit takes one byte before packing.
        step = max(1, (1 << 24) // bits)
        for at in range(0, len(ordered), step):
            part = ordered[at : at + step]
            flags = np.zeros((len(part), bits), np.uint8)
            rows = np.repeat(np.arange(len(part)), lengths[at : at + step])
            if len(rows):
                flags[rows, np.concatenate(part) & (bits - 1)] = 1
            bitmap[at : at + step] = np.packbits(flags, axis=1).view(np.uint64)
        size = sets.sizes[self.order]
        beyond = lengths - np.bitwise_count(bitmap).sum(axis=1).astype(np.int64)
        self.levels = [(bitmap, size, size, beyond)]
        while len(self.levels[-1][0]) > 1:
            bitmap, low, high, beyond = self.levels[-1]
            heads = np.arange(0, len(bitmap), FANOUT)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(bitmap, heads, axis=0),
                    np.minimum.reduceat(low, heads),
                    np.maximum.reduceat(high, heads),
                    np.maximum.reduceat(beyond, heads),
                )
            )

    def nodes(self, level: int):
        return self.levels[min(level, len(self.levels) - 1)]


def bits_for(*sets: Sets) -> int:
    """Bits of the bitmaps: about two for each element of the larger sets."""
    most = max((len(e) for s in sets for e in s.elements), default=0)
    bits = MIN_BITS
    while bits < min(2 * most, MAX_BITS):
        bits *= 2
    return bits


class Forest:
    """Union-find over the sets of a block."""

    def __init__(self, labels: np.ndarray):
        _, first = np.unique(labels, return_inverse=True)
        heads = np.full(first.max() + 1 if len(first) else 0, -1)
        self.parent = np.arange(len(labels))
        for k, group in enumerate(first):
            if heads[group] < 0:
                heads[group] = k
            self.parent[k] = heads[group]

    def find(self, k: int) -> int:
        parent = self.parent
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return int(k)

    def roots(self) -> np.ndarray:
        found = self.parent
        while not np.array_equal(found, found[found]):
            found = found[found]
        self.parent = found.copy()
        return found

    def join(self, a: int, b: int) -> None:
        self.parent[max(a, b)] = min(a, b)


def linked(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (size_a + size_b - shared)


def _possible(left, right, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether any set below node i of ``left`` can link with any below node j of ``right``."""
    bits_a, low_a, high_a, beyond_a = left
    bits_b, low_b, high_b, beyond_b = right
    fits = (100 * high_a[i] >= percent * low_b[j]) & (100 * high_b[j] >= percent * low_a[i])
    at = np.flatnonzero(fits)
    step = max(1, _WORDS_AT_ONCE // bits_a.shape[1])
    for start in range(0, len(at), step):
        part = at[start : start + step]
        x, y = i[part], j[part]
        common = np.bitwise_count(bits_a[x] & bits_b[y]).sum(axis=1).astype(np.int64)
        # Elements of either set that share a bit with another element of it add to the bits.
        most = np.minimum(common + np.minimum(beyond_a[x], beyond_b[y]), np.minimum(high_a[x], high_b[y]))
        fits[part] = (100 + percent) * most >= percent * (low_a[x] + low_b[y])
    return fits


def _uniform(roots: np.ndarray, levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level the smallest and largest component of each node."""
    out = [(roots, roots)]
    for _ in range(levels - 1):
        low, high = out[-1]
        heads = np.arange(0, len(low), FANOUT)
        out.append((np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads)))
    return out


def _children(i: np.ndarray, j: np.ndarray, size_a: int, size_b: int, same: bool, deep_a: bool, deep_b: bool):
    """All pairs of children of the pairs (i, j); of a pair (i, i) within one tree each once."""
    grid = np.arange(FANOUT)
    x = (i[:, None] * FANOUT + grid if deep_a else i[:, None])[:, :, None]
    y = (j[:, None] * FANOUT + grid if deep_b else j[:, None])[:, None, :]
    x, y = np.broadcast_arrays(x, y)
    x, y = x.ravel(), y.ravel()
    keep = (x < size_a) & (y < size_b)
    if same:
        keep &= x <= y
    return x[keep], y[keep]


def _traverse(tree_a: Tree, tree_b: Tree, same: bool, percent: int, needless=None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets, as positions in the trees, that may link and that ``needless`` leaves."""
    top = max(len(tree_a.levels), len(tree_b.levels))
    i = j = np.zeros(1, np.int64)
    for level in range(top - 1, -1, -1):
        if needless:
            gone = needless(level, i, j)
            i, j = i[~gone], j[~gone]
        if same and level == 0:
            i, j = i[i < j], j[i < j]
        fits = _possible(tree_a.nodes(level), tree_b.nodes(level), i, j, percent)
        i, j = i[fits], j[fits]
        if level:
            i, j = _children(
                i, j, len(tree_a.nodes(level - 1)[1]), len(tree_b.nodes(level - 1)[1]), same,
                level < len(tree_a.levels), level < len(tree_b.levels),
            )
    return i, j


def all_links(left: Sets, right: Sets | None, percent: int) -> Iterator[tuple[int, int]]:
    """Every link within ``left``, or between ``left`` and ``right`` where that is given, once."""
    if not len(left) or (right is not None and not len(right)):
        return
    other = left if right is None else right
    shift = 0 if right is None else len(left)
    bits = bits_for(left, other)
    tree_a = Tree(left, bits)
    tree_b = tree_a if right is None else Tree(right, bits)
    i, j = _traverse(tree_a, tree_b, right is None, percent)
    for x, y in zip(i, j):
        a, b = int(tree_a.order[x]), int(tree_b.order[y])
        if linked(left.elements[a], other.elements[b], left.sizes[a], other.sizes[b], percent):
            yield a, b + shift


def spanning_links(
    left: Sets, right: Sets | None, labels: np.ndarray, percent: int
) -> Iterator[tuple[int, int]]:
    """Links that join the components of the sets, as positions (``right`` counted after ``left``).

    Links within ``left``, or between ``left`` and ``right`` where that is given. ``labels``
    names components known before; pairs known to be connected need no link. Every link
    between sets of different components is found or made superfluous by others.
    """
    if not len(left) or (right is not None and not len(right)):
        return
    other = left if right is None else right
    shift = 0 if right is None else len(left)
    forest = Forest(labels)
    bits = bits_for(left, other)
    tree_a = Tree(left, bits)
    tree_b = tree_a if right is None else Tree(right, bits)

    def check(a: int, b: int) -> bool:
        x, y = forest.find(a), forest.find(b + shift)
        if x == y or not linked(left.elements[a], other.elements[b], left.sizes[a], other.sizes[b], percent):
            return False
        forest.join(x, y)
        return True

    if right is None:
        # Close copies mostly share their smallest element: a cheap start that joins big groups.
        near = np.lexsort((left.sizes, [e[0] if len(e) else 0 for e in left.elements]))
        for a, b in zip(near[:-1].tolist(), near[1:].tolist()):
            if check(a, b):
                yield a, b

    def joined(level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        roots = forest.roots()
        at_a, at_b = min(level, len(tree_a.levels) - 1), min(level, len(tree_b.levels) - 1)
        low_a, high_a = _uniform(roots[tree_a.order], len(tree_a.levels))[at_a]
        low_b, high_b = _uniform(roots[tree_b.order + shift], len(tree_b.levels))[at_b]
        return (low_a[i] == high_a[i]) & (low_b[j] == high_b[j]) & (low_a[i] == low_b[j])

    i, j = _traverse(tree_a, tree_b, right is None, percent, joined)
    for a, b in zip(tree_a.order[i].tolist(), tree_b.order[j].tolist()):
        if check(a, b):
            yield a, b + shift
