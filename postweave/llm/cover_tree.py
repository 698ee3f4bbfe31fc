"""A cover tree over vectors lifted to one norm, with covering radii that bound inner products."""

from __future__ import annotations

import heapq

import numpy as np

BASE = 2.0  # a child's covering distance is its parent's largest distance divided by this


class CoverTree:
    """Nets within nets over a sample: a node's children are at least its covering distance apart, and no member is farther from its child.

    One more component gives every point the norm ``largest_norm``, so the angle to a query (whose own extra component is 0) says all about the inner
    product.  The radii are set by ``measure`` from all rows, not from the sample, so the bounds hold for every row.
    """

    def __init__(self, sample: np.ndarray, largest_norm: float):
        self.norm = float(largest_norm) or 1.0
        self.sample = np.asarray(sample, np.float64)
        self.lifted_sample = self.lifted(self.sample)
        self.centre: list[int] = []
        self.parent: list[int] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray | None] = []  # sample rows of a leaf
        stack = [(np.arange(len(self.sample)), 0, -1)]
        while stack:
            inside, centre, parent = stack.pop()
            node = len(self.centre)
            self.centre.append(centre)
            self.parent.append(parent)
            self.children.append([])
            self.members.append(None)
            if parent >= 0:
                self.children[parent].append(node)
            parts = self._net(inside, centre)
            if parts:
                stack += [(part, c, node) for c, part in reversed(parts)]
            else:
                self.members[node] = inside
        self.is_leaf = np.array([m is not None for m in self.members])
        self.leaf_number = np.cumsum(self.is_leaf) - 1  # leaves are numbered depth first, neighbours next to each other
        self.leaf_node = np.flatnonzero(self.is_leaf)
        self.paths = []
        for node in self.leaf_node.tolist():
            path = [node]
            while self.parent[path[-1]] >= 0:
                path.append(self.parent[path[-1]])
            self.paths.append(np.array(path))
        self.centres = np.array(self.centre)
        self.angle = np.full(len(self.centre), np.pi)

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm ** 2 - (vectors ** 2).sum(axis=1), 0))
        return np.hstack([vectors, rest[:, None]])

    def _net(self, inside: np.ndarray, centre: int) -> list[tuple[int, np.ndarray]]:
        """Farthest points first, until every member lies within the covering distance of one; nothing if all members are one point."""
        points = self.lifted_sample[inside]
        near = np.linalg.norm(points - self.lifted_sample[centre], axis=1)
        cover = near.max(initial=0.0) / BASE
        if not cover:
            return []
        who, chosen = np.zeros(len(inside), np.int64), [centre]
        while near.max() > cover:
            far = int(near.argmax())
            distance = np.linalg.norm(points - points[far], axis=1)
            closer = distance < near
            who[closer] = len(chosen)
            near = np.where(closer, distance, near)
            chosen.append(int(inside[far]))
        return [(c, inside[who == i]) for i, c in enumerate(chosen)]

    def route(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child on every level."""
        points = self.lifted(vectors)
        out = np.zeros(len(points), np.int64)
        stack = [(0, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if self.is_leaf[node]:
                out[rows] = self.leaf_number[node]
                continue
            below = np.array(self.children[node])
            chosen = (points[rows] @ self.lifted_sample[self.centres[below]].T).argmax(axis=1)
            order = np.argsort(chosen, kind="stable")
            ends = np.flatnonzero(np.diff(chosen[order], append=-1)) + 1
            begin = 0
            for end in ends.tolist():
                part = order[begin:end]
                stack.append((int(below[chosen[part[0]]]), rows[part]))
                begin = end
        return out

    def distances(self, vectors: np.ndarray, leaves: np.ndarray) -> tuple[dict[int, float], dict[int, int]]:
        """For the nodes above these rows the largest distance to their centre, and for their leaves the number of rows."""
        points = self.lifted(vectors)
        far: dict[int, float] = {}
        rows: dict[int, int] = {}
        order = np.argsort(leaves, kind="stable")
        begin = 0
        for end in (np.flatnonzero(np.diff(leaves[order], append=-1)) + 1).tolist():
            part = order[begin:end]
            leaf = int(leaves[part[0]])
            rows[leaf] = end - begin
            for node in self.paths[leaf].tolist():
                d = float(np.linalg.norm(points[part] - self.lifted_sample[self.centre[node]], axis=1).max())
                far[node] = max(far.get(node, 0.0), d)
            begin = end
        return far, rows

    def measure(self, radii: dict[int, float]) -> None:
        """Set the covering radii, as angles."""
        chord = np.array([radii.get(node, -1.0) for node in range(len(self.centre))])
        angle = 2 * np.arcsin(np.clip(chord / (2 * self.norm), 0, 1)) + 1e-9
        self.angle = np.where(chord < 0, -1.0, angle)  # a node without rows

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores of the sample, smallest and largest inner product below each node) for every query."""
        scores = queries @ self.sample.T
        length = np.linalg.norm(queries, axis=1)[:, None] * self.norm
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(length > 0, scores[:, self.centres] / length, 0.0)
        angle = np.arccos(np.clip(cosine, -1, 1))
        slack = 1e-6 * (1 + length)
        low = length * np.cos(np.minimum(angle + self.angle, np.pi)) - slack
        high = length * np.cos(np.maximum(angle - self.angle, 0)) + slack
        empty = self.angle < 0
        low[:, empty], high[:, empty] = np.inf, -np.inf
        return scores, low, high

    def descend(self, scores: list[float], low: list[float], high: list[float], windows: list[tuple[float, float]], fits: list[bool], k: int):
        """(leaf numbers, raised lower ends): best-first descent for one query.

        A node is opened if one of the ``windows`` (smallest, largest wanted score) meets its range.  Sample rows that fit raise the lower end of a window to their
        k-th best score in it, so the descent ends when the best node left is below all windows.  No row in a window's best k is passed by.
        """
        lows, highs = [w[0] for w in windows], [w[1] for w in windows]
        best: list[list[float]] = [[] for _ in windows]
        each = range(len(windows))
        heap = [(-high[0], 0)]
        found = []
        while heap:
            top, node = heapq.heappop(heap)
            if -top < min(lows):
                break
            if not any(-top >= lows[w] and low[node] <= highs[w] for w in each):
                continue
            members = self.members[node]
            if members is None:
                for child in self.children[node]:
                    heapq.heappush(heap, (-high[child], child))
                continue
            found.append(int(self.leaf_number[node]))
            for m in members.tolist():
                if fits[m]:
                    s = scores[m]
                    for w in each:
                        if lows[w] <= s <= highs[w]:
                            heapq.heappush(best[w], s)
                            if len(best[w]) > k:
                                heapq.heappop(best[w])
                            if len(best[w]) == k:
                                lows[w] = max(lows[w], best[w][0])
        return found, lows
