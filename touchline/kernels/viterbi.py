"""The ball's cheapest path through candidates and occlusions, for many
sequences at a time.

Frames of all sequences lie one after the other in flat arrays. A step takes
the next frame of every sequence that has one, so its cost in numpy calls is
that of one frame, whatever the number of sequences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NONE = np.iinfo(np.int64).min


@dataclass
class Frames:
    """Frames of sequences, in order. balls: frames x candidates x (x, y, w, h,
    score), NaN beyond a frame's own; players: frames x players x (x1, y1, x2,
    y2), NaN beyond; tracks: their names, NONE beyond; motion: frames x 6, the
    affine motion from the frame before; length: frames of each sequence."""

    balls: np.ndarray
    players: np.ndarray
    tracks: np.ndarray
    motion: np.ndarray
    length: np.ndarray


@dataclass
class Path:
    """For each frame its state: a box (NaN where unknown), whether the ball is
    occluded, and the track that holds it (NONE without)."""

    box: np.ndarray
    is_dummy: np.ndarray
    attached: np.ndarray


def _holders(at: np.ndarray, players: np.ndarray, tracks: np.ndarray, foot_pct: float) -> np.ndarray:
    """The first player whose foot zone holds each place, NONE without."""
    if not players.shape[1]:
        return np.full(at.shape[:2], NONE)
    x, y = at[:, :, None, 0], at[:, :, None, 1]
    x1, y1, x2, y2 = (players[:, None, :, k] for k in range(4))
    inside = (x1 <= x) & (x <= x2) & (y2 - foot_pct * (y2 - y1) <= y) & (y <= y2)
    first = inside.argmax(axis=2)
    return np.where(inside.any(axis=2), np.take_along_axis(tracks, first, axis=1), NONE)


def _feet(names: np.ndarray, players: np.ndarray, tracks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the named tracks stand in a frame, and whether they are there."""
    if not players.shape[1]:
        return np.full((*names.shape, 2), np.nan), np.zeros(names.shape, bool)
    same = (tracks[:, None, ::-1] == names[:, :, None]) & (names != NONE)[:, :, None]
    which = tracks.shape[1] - 1 - same.argmax(axis=2)
    own = np.take_along_axis(players, which[:, :, None], axis=1)
    return np.stack([(own[..., 0] + own[..., 2]) / 2, (own[..., 1] + own[..., 3]) / 2], axis=-1), same.any(axis=2)


def ball_paths(frames: Frames, w1: float = 0.6, w2: float = 0.2, w3: float = 0.2, delta_P: float = 500.0, lambda_cost: float = 10.0, alpha: float = 5.0, score_reward: float = 50.0, foot_pct: float = 0.30) -> Path:
    """The path of least cost of each sequence.

    Besides its candidates each frame has an occluded state: it carries the
    position of the player at whose feet the ball vanished, or the last
    position moved with the camera. Candidates are compared with all states of
    the frame before by squared distance (none beyond delta_P), area ratio and
    a penalty for reappearing; ties keep the earlier state, occluded ones last.
    """
    n, most = frames.balls.shape[:2]
    dark = most  # the occluded state's place
    box = np.full((n, most + 1, 4), np.nan)
    box[:, :most] = frames.balls[:, :, :4]
    cost = np.full((n, most + 1), np.inf)
    link = np.full((n, most + 1), -1)
    held = np.full(n, NONE)
    real = ~np.isnan(frames.balls[:, :, 4])
    reward = -score_reward * frames.balls[:, :, 4]
    start = np.cumsum(frames.length) - frames.length
    order = np.argsort(-frames.length, kind="stable")
    start, length = start[order], frames.length[order]
    first = start[length > 0]
    cost[first, :most] = np.where(real[first], reward[first], np.inf)
    cost[first, dark] = lambda_cost
    for t in range(1, int(length.max()) if len(length) else 0):
        now = start[: int(np.searchsorted(-length, -t, side="left"))] + t
        before = now - 1
        old, c = box[before], cost[before]
        m = frames.motion[now][:, None, :]
        moved = np.stack([m[..., 0] * old[..., 0] + m[..., 1] * old[..., 1] + m[..., 2], m[..., 3] * old[..., 0] + m[..., 4] * old[..., 1] + m[..., 5]], axis=-1)
        known = ~np.isnan(old[..., 0])
        if most:
            new = box[now, :most]
            d = np.hypot(moved[:, :, None, 0] - new[:, None, :, 0], moved[:, :, None, 1] - new[:, None, :, 1])
            was = np.nan_to_num(old[..., 2]) * np.nan_to_num(old[..., 3])
            was[:, dark] = 0.0
            own = np.nan_to_num(new[..., 2] * new[..., 3])
            both = (was > 0)[:, :, None] & (own > 0)[:, None, :]
            ratio = np.abs(np.log(np.where(both, was[:, :, None], 1.0) / np.where(both, own[:, None, :], 1.0)))
            total = c[:, :, None] + w1 * np.where(known[:, :, None], (d / delta_P) ** 2, 0.0) + w2 * ratio
            total[:, dark] += w3 * lambda_cost
            total += reward[now][:, None, :]
            total[known[:, :, None] & (d > delta_P)] = np.inf
            total[np.isnan(total)] = np.inf
            best = total.argmin(axis=1)
            least = np.take_along_axis(total, best[:, None, :], axis=1)[:, 0]
            cost[now, :most] = np.where(real[now], least, np.inf)
            link[now, :most] = np.where(np.isfinite(least) & real[now], best, -1)
        names = np.concatenate([_holders(old[:, :most, :2], frames.players[before], frames.tracks[before], foot_pct), held[before][:, None]], axis=1)
        penalty = np.where(names == NONE, lambda_cost, lambda_cost / alpha)
        penalty[:, dark] = 0.0
        total = c + w3 * penalty
        best = total.argmin(axis=1)
        rows = np.arange(len(now))
        name = names[rows, best]
        place, here = _feet(name[:, None], frames.players[now], frames.tracks[now])
        lost = (name != NONE) & ~here[:, 0] & (best != dark)
        at = np.where(here, place[:, 0], np.where(lost[:, None], np.nan, moved[rows, best]))
        box[now, dark] = np.concatenate([at, np.where(lost[:, None], np.nan, old[rows, best, 2:])], axis=1)
        cost[now, dark], link[now, dark], held[now] = total[rows, best], best, name
    state = np.zeros(n, np.int64)
    last = (start + length - 1)[length > 0]
    state[last] = cost[last].argmin(axis=1)
    for back in range(1, int(length.max()) if len(length) else 0):
        now = (start + length - 1)[: int(np.searchsorted(-length, -back, side="left"))] - back
        state[now] = link[now + 1, state[now + 1]]
    every = np.arange(n)
    occluded = state == dark
    return Path(box[every, state], occluded, np.where(occluded, held, NONE))
