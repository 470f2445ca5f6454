"""Weighted acyclic automata over words: counts of word sequences, in numpy.

Words are 64-bit labels other than 0. An automaton has layers: the states at
depth d, each with a weight (the count of the sequence that leads to it, 0 if
none ends there) and its arcs, sorted by symbol, to states at depth d + 1.
Symbols are places in a sorted alphabet. Equal states of a layer are one.
"""

from __future__ import annotations

import numpy as np
import zstandard

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(values: np.ndarray) -> np.ndarray:
    h = values.astype(np.uint64) + _MIX[0]
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return h ^ (h >> np.uint64(32))


def sort_grams(grams: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order, weights of equal rows summed. Short rows end in zeros, so they stand before their continuations."""
    order = np.lexsort(grams.T[::-1])
    grams, weights = grams[order], weights[order]
    if not len(grams):
        return grams, weights
    new = np.flatnonzero(np.concatenate(([True], (grams[1:] != grams[:-1]).any(axis=1))))
    return grams[new], np.add.reduceat(weights, new)


class Automaton:
    def __init__(self, alphabet, weights, first, symbol, target):
        self.alphabet, self.weights, self.first, self.symbol, self.target = alphabet, weights, first, symbol, target

    @classmethod
    def build(cls, grams: np.ndarray, weights: np.ndarray) -> Automaton:
        """From sorted unique rows (n, k) of labels; each row extends what it does not share with the row before it.

        States are closed from the deepest layer up; a state equal to an
        earlier one (weight, symbols and targets) is that one.
        """
        n, k = grams.shape
        alphabet = np.unique(grams[grams > 0])
        symbols = np.searchsorted(alphabet, grams).astype(np.uint32)
        length = (grams > 0).sum(axis=1)
        shared = np.concatenate(([0], (grams[1:] != grams[:-1]).argmax(axis=1))) if n else np.zeros(0, int)
        layers = [np.zeros(1, np.int64), *[np.flatnonzero((shared < d) & (length >= d)) for d in range(1, k + 1)]]
        if n:
            layers[1] = np.union1d(layers[1], [0])
        out = cls(alphabet, [None] * (k + 1), [None] * (k + 1), [None] * k, [None] * k)
        classes = np.zeros(0, np.int64)
        for d in range(k, -1, -1):
            rows = layers[d]
            ends = length[rows] == d if n and d else np.zeros(len(rows), bool)
            weight = np.where(ends, weights[rows], 0) if n else np.zeros(len(rows), np.int64)
            below = layers[d + 1] if d < k else np.zeros(0, np.int64)
            parent = np.searchsorted(rows, below, side="right") - 1
            first = np.concatenate(([0], np.cumsum(np.bincount(parent, minlength=len(rows)))))
            symbol = symbols[below, d] if d < k else np.zeros(0, np.uint32)
            kept, classes = _equal_states(weight, first, symbol, classes_below := classes)
            size = np.diff(first)[kept]
            arcs = np.repeat(first[kept] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            out.weights[d], out.first[d] = weight[kept], np.concatenate(([0], np.cumsum(size)))
            if d < k:
                out.symbol[d], out.target[d] = symbol[arcs], classes_below[arcs].astype(np.uint32)
        return out

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All rows with a weight, and the weights."""
        k = len(self.symbol)
        state, prefix, found, counts = np.zeros(1, np.int64), np.zeros((1, k), np.uint64), [], []
        for d in range(k + 1):
            has = self.weights[d][state] > 0
            found.append(prefix[has])
            counts.append(self.weights[d][state[has]])
            if d < k:
                low = self.first[d][state]
                size = self.first[d][state + 1] - low
                arcs = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                prefix = np.repeat(prefix, size, axis=0)
                prefix[:, d] = self.alphabet[self.symbol[d][arcs]]
                state = self.target[d][arcs].astype(np.int64)
        return np.concatenate(found), np.concatenate(counts)

    @classmethod
    def union(cls, parts: list[Automaton], least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Sorted rows of all parts with their summed weights, from `least` up."""
        each = [p.paths() for p in parts]
        grams, weights = sort_grams(np.concatenate([g for g, _ in each]), np.concatenate([w for _, w in each]))
        return grams[weights >= least], weights[weights >= least]

    def compose(self, grams: np.ndarray) -> np.ndarray:
        """The weight of each row (0 if it has none): all rows walk through the layers together."""
        n, k, width = len(grams), len(self.symbol), grams.shape[1]
        out, at, state = np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64)
        place = np.searchsorted(self.alphabet, grams)
        for d in range(min(k, width) + 1):
            over = grams[at, d] == 0 if d < width else np.ones(len(at), bool)
            out[at[over]] = self.weights[d][state[over]]
            if d == min(k, width) or not len(self.symbol[d]):
                break
            at, state = at[~over], state[~over]
            want = place[at, d]
            low, end = self.first[d][state], self.first[d][state + 1]
            high = end
            while (low < high).any():
                mid = (low + high) // 2
                less = self.symbol[d][np.minimum(mid, len(self.symbol[d]) - 1)] < want
                low, high = np.where((low < high) & less, mid + 1, low), np.where((low < high) & ~less, mid, high)
            hit = np.flatnonzero(low < end)
            hit = hit[(self.symbol[d][low[hit]] == want[hit]) & (self.alphabet[np.minimum(want[hit], len(self.alphabet) - 1)] == grams[at[hit], d])]
            at, state = at[hit], self.target[d][low[hit]].astype(np.int64)
        return out

    def dump(self) -> bytes:
        arrays = [self.alphabet, *self.weights, *self.first, *self.symbol, *self.target]
        arrays = [a if i == 0 else a.astype(_narrow(a)) for i, a in enumerate(arrays)]
        head = np.array([len(self.symbol), *[x for a in arrays for x in (len(a), a.itemsize)]], np.int64)
        return zstandard.ZstdCompressor(level=1).compress(np.int64(len(head)).tobytes() + head.tobytes() + b"".join(a.tobytes() for a in arrays))

    @classmethod
    def load(cls, data: bytes) -> Automaton:
        data = zstandard.ZstdDecompressor().decompress(data)
        n = int(np.frombuffer(data, np.int64, 1)[0])
        head = np.frombuffer(data, np.int64, n, 8)
        at, arrays = 8 * (n + 1), []
        for size, width in head[1:].reshape(-1, 2):
            arrays.append(np.frombuffer(data, f"u{width}", size, at).astype(np.int64 if arrays else np.uint64))
            at += int(size * width)
        k = int(head[0])
        return cls(arrays[0], arrays[1 : k + 2], arrays[k + 2 : 2 * k + 3], arrays[2 * k + 3 : 3 * k + 3], arrays[3 * k + 3 :])


def _narrow(values: np.ndarray) -> str:
    most = int(values.max()) if len(values) else 0
    return next(f"u{w}" for w in (1, 2, 4, 8) if most < 1 << (8 * w))


def _equal_states(weight, first, symbol, target) -> tuple[np.ndarray, np.ndarray]:
    """(places of one state of each class, class of every state); signatures find candidates, arcs are compared."""
    n, size = len(weight), np.diff(first)
    arcs = _mixed(symbol.astype(np.uint64) * _MIX[1] + _mixed(target)) if len(symbol) else np.zeros(0, np.uint64)
    total = np.concatenate(([np.uint64(0)], np.cumsum(arcs, dtype=np.uint64)))
    sign = _mixed(weight.astype(np.uint64)) * _MIX[0] + total[first[1:]] - total[first[:-1]] + size.astype(np.uint64)
    _, kept, classes = np.unique(sign, return_index=True, return_inverse=True)
    twin = kept[classes]
    same = (weight == weight[twin]) & (size == size[twin])
    own = np.repeat(np.arange(n), size)
    place = np.arange(len(symbol)) - first[own] + first[twin[own]]
    ok = same[own].copy()
    there = np.flatnonzero(ok)
    ok[there] = (symbol[there] == symbol[place[there]]) & (target[there] == target[place[there]])
    odd = np.flatnonzero(~(same & (np.bincount(own, ~ok, minlength=n) == 0)))
    if len(odd):  # other states with the same signature stay apart
        classes = classes.copy()
        classes[odd] = len(kept) + np.arange(len(odd))
        kept = np.concatenate((kept, odd))
    return kept, classes
