"""Forests of BK-trees over fingerprints of one or more 64-bit words, built and searched a level at a time in numpy.

In a BK-tree a child hangs from its parent by an edge labelled with their Hamming distance. By the triangle
inequality, a search within radius r that stands at distance d from a node needs to follow only the edges labelled
d - r to d + r. The children of a node lie next to each other, ordered by label, so that those edges are one slice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np



def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of the rows of two arrays (rows, words)."""
    out = np.bitwise_count(a[:, 0] ^ b[:, 0]).astype(np.int64)
    for k in range(1, a.shape[1]):
        out += np.bitwise_count(a[:, k] ^ b[:, k])
    return out


class Forest:
    """One tree for each run of equal values of ``shard``; the fingerprints of a shard must be distinct."""

    def __init__(self, shard: np.ndarray, prints: np.ndarray):
        n = len(prints)
        prints = prints.reshape(n, -1)
        self.prints = prints
        self.labels = labels = 64 * prints.shape[1] + 1
        first = np.r_[True, shard[1:] != shard[:-1]] if n else np.zeros(0, bool)
        starts = np.flatnonzero(first)
        self.sizes = np.diff(np.r_[starts, n])
        self.root = np.repeat(starts, self.sizes)
        at = self.root.copy()
        active = np.flatnonzero(~first)
        keys, nodes = [], []
        while len(active):
            label = at[active] * labels + hamming(prints[active], prints[at[active]])
            key, place, group = np.unique(label, return_index=True, return_inverse=True)
            keys.append(key)
            nodes.append(active[place])
            at[active] = active[place][group]
            left = np.ones(len(active), bool)
            left[place] = False
            active = active[left]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key)
        self.edge = key[order]
        self.child = (np.concatenate(nodes) if nodes else np.zeros(0, np.int64))[order]
        # the slice of each node's children, and their smallest and largest label
        self.first = np.searchsorted(self.edge, np.arange(n) * labels)
        self.last = np.searchsorted(self.edge, np.arange(n) * labels + labels)
        some = self.last > self.first
        self.least, self.most = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.least[some] = self.edge[self.first[some]] % labels
        self.most[some] = self.edge[self.last[some] - 1] % labels

    def search(self, radius: int, budget: int = 300_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs (i, j, distance), i > j, of one shard within ``radius``, in pieces: all pairs of as many queries i at
        a time as can visit at most about ``budget`` nodes."""
        n, labels = len(self.prints), self.labels
        load = np.cumsum(np.repeat(self.sizes, self.sizes))
        begin = 0
        while begin < n:
            end = max(begin + 1, int(np.searchsorted(load, (load[begin - 1] if begin else 0) + budget, "right")))
            query = np.arange(begin, end)
            query = query[self.root[query] < query]
            node = self.root[query]
            begin = end
            found = []
            while len(query):
                d = hamming(self.prints[query], self.prints[node])
                hit = np.flatnonzero(d <= radius)
                if len(hit):
                    found.append((query[hit], node[hit], d[hit]))
                low, high = self.first[node], self.last[node]
                cut = np.flatnonzero((high > low) & ((d - radius > self.least[node]) | (d + radius < self.most[node])))
                if len(cut):  # only some of the node's edges lie within the radius
                    at, e = node[cut] * labels, d[cut]
                    low[cut] = np.searchsorted(self.edge, at + np.maximum(e - radius, 1))
                    high[cut] = np.searchsorted(self.edge, at + np.minimum(e + radius, labels - 1), "right")
                count = high - low
                to = np.cumsum(count)
                total = int(to[-1]) if len(to) else 0
                if not total:
                    break
                query = np.repeat(query, count)
                node = self.child[np.arange(total) + np.repeat(low - (to - count), count)]
                # whatever hangs below a node came after it, so nothing earlier than the query is lost
                ahead = np.flatnonzero(node < query)
                query, node = query[ahead], node[ahead]
            if found:
                yield tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Union:
    """Sets of the numbers below n, each named by its smallest member. Links come in arrays."""

    def __init__(self, n: int):
        self.to = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Unites; returns the places of links that joined two sets (a spanning forest of what is new)."""
        ra, rb = self.to[a], self.to[b]
        apart = np.flatnonzero(ra != rb)
        if not len(apart):
            return apart
        _, first = np.unique(np.minimum(ra, rb)[apart] * len(self.to) + np.maximum(ra, rb)[apart], return_index=True)
        apart = np.sort(apart[first])
        to, used = self.to, []
        for k, x, y in zip(apart.tolist(), ra[apart].tolist(), rb[apart].tolist(), strict=True):
            while to[x] != x:
                x = to[x]
            while to[y] != y:
                y = to[y]
            if x != y:
                to[max(x, y)] = min(x, y)
                used.append(k)
        while True:
            flat = to[to]
            if (flat == to).all():
                break
            to = flat
        self.to = to
        return np.array(used, np.int64)
