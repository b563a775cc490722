"""Hull, rotations and the SO(3) camera smoother, in numpy."""

from __future__ import annotations

import numpy as np


def hull_area(points: np.ndarray) -> float | None:
    """Area of the convex hull, null for fewer than three points or a
    degenerate set."""
    pts = np.unique(np.asarray(points, float).reshape(-1, 2), axis=0)
    if len(pts) < 3:
        return None

    def chain(seq: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = np.array(chain(pts) + chain(pts[::-1]))
    area = 0.5 * abs(float(np.dot(ring[:, 0], np.roll(ring[:, 1], -1)) - np.dot(ring[:, 1], np.roll(ring[:, 0], -1))))
    return area if area > 1e-12 else None


def rotation(v: np.ndarray) -> np.ndarray:
    """Rotation matrix of a rotation vector."""
    angle = float(np.linalg.norm(v))
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    if angle < 1e-9:
        return np.eye(3) + k
    return np.eye(3) + np.sin(angle) / angle * k + (1 - np.cos(angle)) / angle**2 * (k @ k)


def rotation_vector(r: np.ndarray) -> np.ndarray:
    """Rotation vector of a rotation matrix, for any angle up to pi."""
    # the quaternion's largest component first, which is never near zero
    m = np.array([np.trace(r), r[0, 0], r[1, 1], r[2, 2]])
    k = int(np.argmax(m))
    q = np.empty(4)
    if k == 0:
        q[0] = 1 + m[0]
        q[1:] = r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]
    else:
        i, j, l = k - 1, k % 3, (k + 1) % 3
        q[0] = r[l, j] - r[j, l]
        q[1 + i] = 1 + r[i, i] - r[j, j] - r[l, l]
        q[1 + j], q[1 + l] = r[i, j] + r[j, i], r[i, l] + r[l, i]
    q /= np.linalg.norm(q)
    if q[0] < 0:
        q = -q
    s = float(np.linalg.norm(q[1:]))
    return 2 * q[1:] if s < 1e-12 else 2 * np.arctan2(s, q[0]) / s * q[1:]


#: Fixed values of the camera smoother.
ROTATION_GAIN, ROTATION_LOW, ROTATION_HIGH = 0.30, 0.08, 0.50
FOCAL_GAIN, POSITION_GAIN, VELOCITY_GAIN, REJECT_DECAY = 0.05, 0.10, 0.15, 0.80
ROTATION_GATE_DEG, BACKWARD_GATE_DEG, FOCAL_GATE, POSITION_GATE_M, REPROJECTION_GATE_PX = 7.0, 5.0, 0.20, 20.0, 20.0
FORCED_ROTATION, FORCED_FOCAL, FORCED_POSITION = 0.8, 0.5, 0.8
MOST_REJECTS, WARMUP = 15, 3


def _pass(frames: list[dict | None], predict: bool) -> list[dict | None]:
    """One direction. The camera turns on at its velocity (if `predict`), a
    measurement within the gates corrects it in part, and one beyond them is
    skipped until too many in a row were. The first frames are taken as they
    are; a frame without measurement only turns on."""
    now: dict | None = None
    velocity, rejects = np.zeros(3), 0
    out: list[dict | None] = []

    def turned_on(guess: np.ndarray) -> None:
        nonlocal now, velocity
        if predict:
            now, velocity = now | {"R": guess}, velocity * REJECT_DECAY

    for i, m in enumerate(frames):
        guess = now["R"] @ rotation(velocity) if now and predict else now["R"] if now else None
        if m is None:
            if now:
                turned_on(guess)
        elif now is None or i < WARMUP:
            now, velocity = {k: m[k] for k in ("R", "fx", "fy", "cx", "cy", "pos")}, np.zeros(3)
        elif m["rep_err"] > REPROJECTION_GATE_PX:
            rejects += 1
            turned_on(guess)
        else:
            rest = rotation_vector(guess.T @ m["R"])
            degrees = float(np.degrees(np.linalg.norm(rest)))
            near = degrees <= (ROTATION_GATE_DEG if predict else BACKWARD_GATE_DEG) and float(np.linalg.norm(m["pos"] - now["pos"])) <= POSITION_GATE_M
            near = near and (now["fx"] <= 0 or abs(m["fx"] - now["fx"]) / now["fx"] <= FOCAL_GATE)
            if not near and rejects < MOST_REJECTS:
                rejects += 1
                turned_on(guess)
            else:
                rejects = 0
                if near:
                    trust = float(np.clip(np.exp(-m["rep_err"] / 8) * (1.0 if m["source"] == "voting" else 0.7) * np.exp(-degrees / 4), 0.15, 1))
                    gain, focal, place = float(np.clip(ROTATION_GAIN * trust, ROTATION_LOW, ROTATION_HIGH)), FOCAL_GAIN, POSITION_GAIN
                else:
                    gain, focal, place = FORCED_ROTATION, FORCED_FOCAL, FORCED_POSITION
                    rest = rotation_vector(now["R"].T @ m["R"])
                moved = guess @ rotation(gain * rest)
                if predict:
                    velocity = VELOCITY_GAIN * rotation_vector(now["R"].T @ moved) + (1 - VELOCITY_GAIN) * velocity
                now = {"R": moved, **{k: focal * m[k] + (1 - focal) * now[k] for k in ("fx", "fy", "cx", "cy")}, "pos": place * m["pos"] + (1 - place) * now["pos"]}
        out.append(dict(now) if now else None)
    return out


def smooth_cameras(frames: list[dict | None], forward: float = 0.5) -> list[dict | None]:
    """Cameras smoothed in both directions and merged: rotations along the
    geodesic, other parameters linearly. Frames without a measurement are None."""
    ahead = _pass(frames, True)
    back = _pass(frames[::-1], False)[::-1]
    out = []
    for a, b in zip(ahead, back, strict=True):
        if a is None or b is None:
            out.append(a or b)
            continue
        turn = rotation_vector(a["R"].T @ b["R"])
        out.append({"R": a["R"] @ rotation((1 - forward) * turn), **{k: forward * a[k] + (1 - forward) * b[k] for k in ("fx", "fy", "cx", "cy", "pos")}})
    return out
