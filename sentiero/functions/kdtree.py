"""k-d trees over three-dimensional unit vectors (NumPy): splits of the sphere for partitioning, and radius queries."""

from __future__ import annotations

import numpy as np

EARTH_M = 6_371_000.0


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Unit vectors of positions in degrees."""
    a, o = np.radians(np.asarray(lat, float)), np.radians(np.asarray(lon, float))
    return np.column_stack((np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)))


def chord(metres: float) -> float:
    """Length of the chord under an arc of ``metres`` on the unit sphere, with room for rounding."""
    return 2 * np.sin(min(metres / EARTH_M, np.pi) / 2) * (1 + 1e-9) + 1e-12


def haversine_m(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    p, q = np.radians(lat1), np.radians(lat2)
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


class Splits:
    """A k-d partition of space: planes halve the sample at each level, down to ``leaf`` points or identical ones."""

    def __init__(self, sample: np.ndarray, leaf: int) -> None:
        self.axis, self.at, self.low, self.high = [], [], [], []
        self.leaves = 0
        self._grow(sample, max(1, leaf))

    def _grow(self, p: np.ndarray, leaf: int) -> int:
        """Index of the node: >= 0 an inner node, otherwise -1 - leaf number."""
        if len(p) > leaf:
            spread = p.max(axis=0) - p.min(axis=0)
            axis = int(spread.argmax())
            at = float(np.median(p[:, axis]))
            right = p[:, axis] > at
            if right.any() and not right.all():
                node = len(self.axis)
                self.axis.append(axis)
                self.at.append(at)
                self.low.append(0)
                self.high.append(0)
                self.low[node] = self._grow(p[~right], leaf)
                self.high[node] = self._grow(p[right], leaf)
                return node
        self.leaves += 1
        return -self.leaves

    def reach(self, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf whose half-spaces lie within ``radius`` of the row's point; radius 0 gives one each."""
        rows, leaves = [], []
        todo = [(0 if self.axis else -1, np.arange(len(p)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                leaves.append(np.full(len(at), -1 - node, dtype=np.int32))
                continue
            gap = p[at, self.axis[node]] - self.at[node]
            todo.append((self.low[node], at[gap <= radius]))
            todo.append((self.high[node], at[gap > -radius]))
        if not rows:
            return np.empty(0, int), np.empty(0, np.int32)
        return np.concatenate(rows), np.concatenate(leaves)


def pairs_within(queries: np.ndarray, points: np.ndarray, radius: float, bucket: int = 32):
    """Yield arrays (query, point) of all pairs at most ``radius`` apart: a k-d tree over points, queried by sets."""
    if not len(queries) or not len(points):
        return
    order = np.arange(len(points))
    todo = [(order, np.arange(len(queries)))]
    while todo:
        mine, asked = todo.pop()
        box = points[mine]
        low, high = box.min(axis=0), box.max(axis=0)
        near = np.maximum(0, np.maximum(low - queries[asked], queries[asked] - high))
        asked = asked[(near**2).sum(axis=1) <= radius * radius]
        if not len(asked):
            continue
        spread = high - low
        if len(mine) <= bucket or not spread.any():
            step = max(1, 2_000_000 // len(mine))
            for i in range(0, len(asked), step):
                some = asked[i : i + step]
                gap = ((queries[some, None, :] - box[None, :, :]) ** 2).sum(axis=2)
                q, p = np.nonzero(gap <= radius * radius)
                if len(q):
                    yield some[q], mine[p]
            continue
        axis = int(spread.argmax())
        half = len(mine) // 2
        by = np.argpartition(box[:, axis], half)
        todo.append((mine[by[:half]], asked))
        todo.append((mine[by[half:]], asked))
