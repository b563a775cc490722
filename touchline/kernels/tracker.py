"""An online tracker: boxes of a frame to tracks."""

from __future__ import annotations

import numpy as np

from touchline.kernels.boxes import overlaps
from touchline.kernels.hungarian import assign


def step(state: list[list[float]], next_id: int, frame: int, boxes: np.ndarray, max_age: int = 30, min_hits: int = 3, least: float = 0.3) -> tuple[list[list[float]], int, list[tuple[int, bool]]]:
    """(tracks, next id, (track, confirmed) of each box). A track is [id, x, y,
    w, h, last frame, hits]; it expires `max_age` frames after its last box,
    and is confirmed from `min_hits` boxes on."""
    alive = [t for t in state if frame - t[5] <= max_age]
    names: list[int | None] = [None] * len(boxes)
    if alive and len(boxes):
        overlap = overlaps(boxes, np.array([t[1:5] for t in alive]))
        near = overlap >= least
        if near.sum(axis=0).max() <= 1 and near.sum(axis=1).max() <= 1:  # no two compete
            pairs = np.argwhere(near).tolist()
        else:
            pairs = [(i, j) for i, j in assign(np.where(near, 1 - overlap, np.inf)) if near[i, j]]
        for i, j in pairs:
            names[i] = j
    out = []
    for box, j in zip(boxes.tolist(), names, strict=True):
        if j is None:
            alive.append([float(next_id), *box, float(frame), 1.0])
            out.append((next_id, min_hits <= 1))
            next_id += 1
        else:
            t = alive[j]
            t[1:5], t[5], t[6] = box, float(frame), t[6] + 1
            out.append((int(t[0]), t[6] >= min_hits))
    return alive, next_id, out
