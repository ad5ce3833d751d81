"""Gradient-boosted trees for a few classes, on a bounded sample held in memory: histogram splits, Newton leaves, softmax loss."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 48


@dataclass
class Forest:
    """Complete trees of equal depth: feature and threshold of every inner node, value of every leaf, by round and class."""

    features: np.ndarray  # rounds x classes x (2^depth - 1)
    thresholds: np.ndarray
    leaves: np.ndarray  # rounds x classes x 2^depth
    start: np.ndarray  # classes
    temperature: float = 1.0
    shift: np.ndarray | None = None  # classes, added to calibrated scores

    @property
    def depth(self) -> int:
        return int(np.log2(self.leaves.shape[2]))

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(self.start, (len(x), 1)).astype(float)
        rows = np.arange(len(x))
        for r in range(self.leaves.shape[0]):
            for c in range(self.leaves.shape[1]):
                node = np.zeros(len(x), dtype=np.int64)
                for _ in range(self.depth):
                    right = x[rows, self.features[r, c, node]] > self.thresholds[r, c, node]
                    node = 2 * node + 1 + right
                out[:, c] += self.leaves[r, c, node - (2**self.depth - 1)]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.scores(x) / self.temperature
        return softmax(z if self.shift is None else z + self.shift)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _grow(binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, width = binned.shape
    inner = 2**depth - 1
    feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
    node = np.zeros(n, dtype=np.int64)
    for level in range(depth):
        first, count = 2**level - 1, 2**level
        local = node - first
        g = np.zeros((width, count, BINS))
        h = np.zeros((width, count, BINS))
        for f in range(width):
            at = local * BINS + binned[:, f]
            g[f] = np.bincount(at, grad, count * BINS).reshape(count, BINS)
            h[f] = np.bincount(at, hess, count * BINS).reshape(count, BINS)
        gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
        gt, ht = gl[:, :, -1:], hl[:, :, -1:]
        gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
        gain[(hl < 1e-3) | (ht - hl < 1e-3)] = -1
        for k in range(count):
            f, b = np.unravel_index(gain[:, k].argmax(), gain[:, k].shape)
            if gain[f, k, b] > 1e-9 and b < len(edges[f]):
                feature[first + k], threshold[first + k] = f, edges[f][b]
        right = np.zeros(n, dtype=np.int64)
        for k in range(count):
            mine = local == k
            if np.isfinite(threshold[first + k]):
                f = feature[first + k]
                right[mine] = binned[mine, f] > np.searchsorted(edges[f], threshold[first + k])
        node = 2 * node + 1 + right
    leaf = node - inner
    gs, hs = np.bincount(leaf, grad, 2**depth), np.bincount(leaf, hess, 2**depth)
    return feature, threshold, -gs / (hs + penalty), leaf


def fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 40, depth: int = 4, rate: float = 0.2, penalty: float = 1.0) -> Forest:
    """Trees for classes 0..classes-1; every class is given a little prior weight, so an absent one is improbable, not impossible."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(x.shape[1])]
    # a bin holds what lies above the edge before it and not above its own
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1)
    prior = (np.bincount(y, minlength=classes) + 1) / (len(y) + classes)
    start = np.log(prior)
    z = np.tile(start, (len(y), 1))
    hot = np.eye(classes)[y]
    features, thresholds, leaves = [], [], []
    for _ in range(rounds):
        p = softmax(z)
        trees = []
        for c in range(classes):
            f, t, v, leaf = _grow(binned, edges, p[:, c] - hot[:, c], p[:, c] * (1 - p[:, c]) + 1e-6, depth, penalty)
            v = np.clip(rate * v, -1, 1)
            trees.append((f, t, v))
            z[:, c] += v[leaf]
        features.append([t[0] for t in trees])
        thresholds.append([t[1] for t in trees])
        leaves.append([t[2] for t in trees])
    return Forest(np.array(features), np.array(thresholds), np.array(leaves), start)


def calibrate(forest: Forest, x: np.ndarray, y: np.ndarray, steps: int = 300, hold: float = 5.0) -> Forest:
    """Temperature and class shifts that fit held-out labels best; `hold` rows' worth of weight keeps them near none for few labels."""
    if not len(y):
        return forest
    classes = len(forest.start)
    z = forest.scores(x)
    log_t, shift = 0.0, np.zeros(classes)
    hot = np.eye(classes)[y]
    for _ in range(steps):
        s = z / np.exp(log_t)
        d = (softmax(s + shift) - hot) / (len(y) + hold)
        g_shift = d.sum(axis=0) + hold / (len(y) + hold) * shift
        g_t = -(d * s).sum() + hold / (len(y) + hold) * log_t
        shift -= 0.5 * g_shift
        log_t -= 0.1 * np.clip(g_t, -1, 1)
    forest.temperature, forest.shift = float(np.exp(log_t)), shift
    return forest
