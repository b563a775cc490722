"""Plain versions that tests compare operators with: one row, frame or state at a time."""

from __future__ import annotations

import numpy as np


def _moved(m: np.ndarray, x: float, y: float) -> tuple[float, float]:
    return float(m[0] * x + m[1] * y + m[2]), float(m[3] * x + m[4] * y + m[5])


def ball_path(frames: list[dict], w1: float = 0.6, w2: float = 0.2, w3: float = 0.2, delta_P: float = 500.0, lambda_cost: float = 10.0, alpha: float = 5.0, score_reward: float = 50.0, foot_pct: float = 0.30) -> list[dict]:
    """One state for each frame: x, y, w, h, is_dummy, attached.

    A frame has `balls` (x, y, w, h, score: centre format), `players` (track,
    x1, y1, x2, y2) and `m`, the affine motion from the frame before. Besides
    its candidates each frame has an occluded state: it carries the position of
    the player at whose feet the ball vanished, or the last position moved with
    the camera. Candidates are compared with all states of the frame before by
    squared distance (none beyond delta_P), area ratio and a penalty for
    reappearing; ties keep the earlier state.
    """
    if not frames:
        return []

    def seen(b: dict) -> dict:
        return {"x": b["x"], "y": b["y"], "w": b["w"], "h": b["h"], "is_dummy": False, "attached": None}

    hidden = {"x": None, "y": None, "w": None, "h": None, "is_dummy": True, "attached": None}
    states = [[*map(seen, frames[0]["balls"]), dict(hidden)]]
    costs = [[*(-score_reward * b["score"] for b in frames[0]["balls"]), lambda_cost]]
    links: list[list[int]] = [[-1] * len(states[0])]
    for before, now in zip(frames, frames[1:], strict=False):
        m = now["m"]
        feet = {p["track"]: ((p["x1"] + p["x2"]) / 2, (p["y1"] + p["y2"]) / 2) for p in now["players"]}
        old, old_cost = states[-1], costs[-1]
        carried = [_moved(m, s["x"], s["y"]) if s["x"] is not None else None for s in old]
        row, row_cost, row_link = [seen(b) for b in now["balls"]], [], []
        if row:
            # costs of all steps from old states (rows) to candidates (columns)
            known = np.array([c is not None for c in carried])
            place = np.array([c or (0.0, 0.0) for c in carried])
            dark = np.array([s["is_dummy"] for s in old])
            was = np.array([0.0 if s["is_dummy"] else (s["w"] or 0.0) * (s["h"] or 0.0) for s in old])
            is_ = np.array([b["w"] * b["h"] for b in row])
            d = np.hypot(place[:, :1] - [[b["x"] for b in row]], place[:, 1:] - [[b["y"] for b in row]])
            step = np.where(known[:, None], (d / delta_P) ** 2, 0.0)
            both = (was > 0)[:, None] & (is_ > 0)[None]
            area = np.abs(np.log(np.where(both, was[:, None], 1.0) / np.where(both, is_[None], 1.0)))
            cost = np.array(old_cost)[:, None] + w1 * step + w2 * area + w3 * np.where(dark, lambda_cost, 0.0)[:, None] - score_reward * np.array([b["score"] for b in now["balls"]])
            cost[known[:, None] & (d > delta_P)] = np.inf
            best = cost.argmin(axis=0)
            row_cost = cost[best, np.arange(len(row))].tolist()
            row_link = [int(i) if np.isfinite(c) else -1 for i, c in zip(best, row_cost, strict=True)]
        least, link, chosen = np.inf, -1, dict(hidden)
        for i, (s, c) in enumerate(zip(old, old_cost, strict=True)):
            own = hidden | {"w": s["w"], "h": s["h"]}
            penalty = 0.0
            if s["is_dummy"]:
                own["attached"] = s["attached"]
            else:
                holder = next((p for p in before["players"] if p["x1"] <= s["x"] <= p["x2"] and p["y2"] - foot_pct * (p["y2"] - p["y1"]) <= s["y"] <= p["y2"]), None)
                penalty = lambda_cost / alpha if holder else lambda_cost
                own["attached"] = holder["track"] if holder else None
            if own["attached"] in feet:
                own["x"], own["y"] = feet[own["attached"]]
            elif own["attached"] is not None and not s["is_dummy"]:
                own["w"] = own["h"] = None
            elif carried[i] is not None:
                own["x"], own["y"] = carried[i]
            if c + w3 * penalty < least:
                least, link, chosen = c + w3 * penalty, i, own
        states.append([*row, chosen])
        costs.append([*row_cost, least])
        links.append([*row_link, link])
    at = int(np.argmin(costs[-1]))
    path = []
    for row, link in zip(reversed(states), reversed(links), strict=True):
        path.append(row[at])
        at = link[at]
    return path[::-1]


def best_total(gain: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """The one-to-one pairs of most total gain, by trying all."""
    import itertools

    rows, columns = gain.shape
    small = range(min(rows, columns))
    options = (list(zip(r, c, strict=True)) for r in itertools.combinations(range(rows), len(small)) for c in itertools.permutations(range(columns), len(small)))
    return max(((sum(gain[i, j] for i, j in o), o) for o in options), key=lambda x: x[0], default=(0.0, []))


def overlap(a: dict, b: dict) -> float:
    w = max(0.0, min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"]))
    h = max(0.0, min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"]))
    return w * h / (a["w"] * a["h"] + b["w"] * b["h"] - w * h)


def hota(pred: dict, gt: dict, level: float) -> tuple[float, float, float]:
    """(det_a, ass_a, hota) of one sequence at one threshold; pred, gt: frame -> track -> box."""
    soft, n_p, n_g = {}, {}, {}
    for f in set(pred) | set(gt):
        p, g = pred.get(f, {}), gt.get(f, {})
        for t in p:
            n_p[t] = n_p.get(t, 0) + 1
        for t in g:
            n_g[t] = n_g.get(t, 0) + 1
        o = {(a, b): overlap(p[a], g[b]) for a in p for b in g}
        for (a, b), v in o.items():
            total = sum(o[a, x] for x in g) + sum(o[x, b] for x in p) - v
            if v > 0:
                soft[a, b] = soft.get((a, b), 0.0) + v / total
    aligned = {(a, b): s / (n_p[a] + n_g[b] - s) for (a, b), s in soft.items()}
    counts: dict = {}
    for f in set(pred) & set(gt):
        p, g = list(pred[f]), list(gt[f])
        gain = np.array([[overlap(pred[f][a], gt[f][b]) * aligned.get((a, b), 0.0) for b in g] for a in p])
        for i, j in best_total(gain)[1]:
            if overlap(pred[f][p[i]], gt[f][g[j]]) >= level - 1e-9:
                counts[p[i], g[j]] = counts.get((p[i], g[j]), 0) + 1
    tp = sum(counts.values())
    det = tp / max(1, sum(n_p.values()) + sum(n_g.values()) - tp)
    ass = sum(c * c / (n_p[a] + n_g[b] - c) for (a, b), c in counts.items()) / max(1, tp)
    return det, ass, (det * ass) ** 0.5


def detection_outcomes(boxes: list[dict], truths: list[dict], level: float, low: float, high: float) -> list[int]:
    """Outcome (0 miss, 1 hit, 2 ignored) of each detection, best first, as the benchmark's loops find it."""
    size = lambda b: b["w"] * b["h"]
    ignored = [not low <= size(t) <= high for t in truths]
    order = sorted(range(len(truths)), key=lambda k: ignored[k])
    taken, out = set(), []
    for b in boxes:
        best, at = level, None
        for k in order:
            if k in taken:
                continue
            if at is not None and not ignored[at] and ignored[k]:
                break
            v = overlap(b, truths[k])
            if v > best or (at is None and v >= best):
                best, at = v, k
        if at is None:
            out.append(0 if low <= size(b) <= high else 2)
        else:
            taken.add(at)
            out.append(2 if ignored[at] else 1)
    return out
