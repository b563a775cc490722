"""Overlap of boxes (x, y, w, h), in numpy."""

from __future__ import annotations

import numpy as np


def overlaps(a: np.ndarray, b: np.ndarray, floor: float = 1e-9) -> np.ndarray:
    """Intersection over union of each box of a with each of b, over a union of
    at least `floor`."""
    iw = np.clip(np.minimum(a[:, None, 0] + a[:, None, 2], b[None, :, 0] + b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0]), 0, None)
    ih = np.clip(np.minimum(a[:, None, 1] + a[:, None, 3], b[None, :, 1] + b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1]), 0, None)
    union = (a[:, 2] * a[:, 3])[:, None] + (b[:, 2] * b[:, 3])[None] - iw * ih
    return iw * ih / np.maximum(union, floor)
