"""Minimum-cost assignment of a rectangular cost matrix, in numpy."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """min(rows, columns) pairs (row, column) of least total cost, by shortest
    augmenting paths with potentials. Infinite costs count as very large, so a
    complete matching always exists. Ties go to the lower column."""
    cost = np.asarray(cost, float)
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T))
    finite = np.isfinite(cost)
    big = (np.abs(cost[finite]).max() + 1) * (sum(cost.shape) + 1) if finite.any() else 1.0
    cost = np.where(finite, cost, big)
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner, held = np.full(m, -1), {}
    for start in range(n):
        reach = np.full(m, np.inf)
        back = np.full(m, -1)
        done = np.zeros(m, bool)
        row, col = start, -1
        level = 0.0
        visited = [start]
        while True:
            slack = level + cost[row] - row_price[row] - col_price
            better = ~done & (slack < reach)
            reach[better] = slack[better]
            back[better] = row
            col = int(np.argmin(np.where(done, np.inf, reach)))
            level = reach[col]
            done[col] = True
            if owner[col] < 0:
                break
            row = int(owner[col])
            visited.append(row)
        # prices move by how much earlier than the end each node was reached
        at = {int(owner[c]): reach[c] for c in np.flatnonzero(done) if owner[c] >= 0}
        for r in visited:
            row_price[r] += level - at.get(r, 0.0)
        col_price[done] -= level - reach[done]
        row = -1
        while row != start:  # along the path, each column goes to the row that reached it
            row = int(back[col])
            before = held.get(row, -1)
            owner[col], held[row] = row, col
            col = before
    return sorted((int(owner[c]), int(c)) for c in range(m) if owner[c] >= 0)
