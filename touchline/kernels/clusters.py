"""K-Means and DBSCAN on the descriptors of one sequence, in numpy."""

from __future__ import annotations

import numpy as np


def kmeans(x: np.ndarray, k: int = 2, restarts: int = 10, seed: int = 42, rounds: int = 100) -> np.ndarray:
    """Labels of the restart with the least inertia."""
    rng = np.random.default_rng(seed)
    if len(x) <= k:
        return np.arange(len(x))
    best, labels = np.inf, np.zeros(len(x), int)
    for _ in range(restarts):
        # k-means++ start
        centres = [x[rng.integers(len(x))]]
        while len(centres) < k:
            d = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
            p = d / d.sum() if d.sum() > 0 else None
            centres.append(x[rng.choice(len(x), p=p)])
        centres = np.array(centres, float)
        for _ in range(rounds):
            d = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
            own = d.argmin(axis=1)
            moved = np.array([x[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(k)])
            if np.allclose(moved, centres):
                break
            centres = moved
        inertia = float(d[np.arange(len(x)), own].sum())
        if inertia < best - 1e-12:
            best, labels = inertia, own
    return labels


def dbscan(x: np.ndarray, eps: float = 0.12, least: int = 3) -> np.ndarray:
    """Cluster labels, -1 for noise."""
    near = np.stack([((x - row) ** 2).sum(axis=1) for row in x]) <= eps * eps
    core = near.sum(axis=1) >= least
    labels = np.full(len(x), -1)
    mark = 0
    for i in range(len(x)):
        if labels[i] >= 0 or not core[i]:
            continue
        edge = [i]
        labels[i] = mark
        while edge:
            j = edge.pop()
            if core[j]:
                for n in np.flatnonzero(near[j] & (labels < 0)).tolist():
                    labels[n] = mark
                    edge.append(n)
        mark += 1
    return labels


def outlier_kmeans(x: np.ndarray, k: int = 2, eps: float = 0.12, least: int = 3, inside: np.ndarray | None = None) -> np.ndarray:
    """K-Means on DBSCAN's inliers (or those given), -1 for outliers; on all if
    too few are in."""
    inside = dbscan(x, eps, least) >= 0 if inside is None else inside
    if inside.sum() < max(k, 2):
        return kmeans(x, k)
    labels = np.full(len(x), -1)
    labels[inside] = kmeans(x[inside], k)
    return labels


def silhouette(x: np.ndarray, labels: np.ndarray) -> float | None:
    """Mean silhouette with Euclidean distances."""
    names = np.unique(labels)
    if len(names) < 2 or len(names) >= len(x):
        return None
    d = np.stack([np.sqrt(((x - row) ** 2).sum(axis=1)) for row in x])
    sums = np.stack([d[:, labels == n].sum(axis=1) for n in names], axis=1)
    sizes = np.array([(labels == n).sum() for n in names])
    own = np.searchsorted(names, labels)
    rows = np.arange(len(x))
    a = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
    others = sums / sizes
    others[rows, own] = np.inf
    b = others.min(axis=1)
    s = np.where(sizes[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
    return float(s.mean())


def davies_bouldin(x: np.ndarray, labels: np.ndarray) -> float | None:
    names = np.unique(labels)
    if len(names) < 2:
        return None
    centres = np.array([x[labels == n].mean(axis=0) for n in names])
    spread = np.array([np.linalg.norm(x[labels == n] - c, axis=1).mean() for n, c in zip(names, centres, strict=True)])
    apart = np.linalg.norm(centres[:, None] - centres[None], axis=2)
    np.fill_diagonal(apart, np.inf)
    return float(((spread[:, None] + spread[None]) / apart).max(axis=1).mean())
