"""What columns express in vectors and geometry, over the NumPy arrays of one image's model outputs."""

from __future__ import annotations

import numpy as np

from ..plans.preprocess import PreprocessSpec, fit_of


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def sigmoid_if_needed(x: np.ndarray) -> np.ndarray:
    """Through a sigmoid if any value leaves 0..1 noticeably."""
    return sigmoid(x) if x.size and (x.min() < 0 or x.max() > 1.001) else x


def softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def centre_boxes(x: np.ndarray) -> np.ndarray:
    """cx, cy, w, h to corners."""
    return np.hstack([x[:, :2] - x[:, 2:4] / 2, x[:, :2] + x[:, 2:4] / 2])


def clip_boxes(boxes: np.ndarray, width: int, height: int) -> np.ndarray:
    return np.clip(boxes, 0, [width, height, width, height])


def unfit(boxes: np.ndarray, spec: PreprocessSpec, width: int, height: int) -> np.ndarray:
    """Corners in the model's input to corners in the image it was made of."""
    w, h, _, _, left, top = fit_of(spec, width, height)
    return (boxes - [left, top, left, top]) * ([width / w, height / h] * 2)


def keep_boxes(boxes: np.ndarray, scores: np.ndarray, threshold: float, groups: np.ndarray | None = None) -> np.ndarray:
    """Numbers of the boxes that no surer one (of the same group) overlaps by more than the threshold, surest first, of ties the first."""
    order = np.argsort(-scores, kind="stable")
    area = np.maximum(boxes[:, 2] - boxes[:, 0], 0) * np.maximum(boxes[:, 3] - boxes[:, 1], 0)
    open_ = np.ones(len(order), bool)
    kept = []
    for place, i in enumerate(order):
        if not open_[place]:
            continue
        kept.append(i)
        rest = order[place + 1 :]
        side = np.minimum(boxes[i, 2:], boxes[rest, 2:]) - np.maximum(boxes[i, :2], boxes[rest, :2])
        inter = np.maximum(side, 0).prod(axis=1)
        base = area[i] + area[rest] - inter
        hit = (base > 0) & (inter > threshold * base)
        if groups is not None:
            hit &= groups[rest] == groups[i]
        open_[place + 1 :] &= ~hit
    return np.array(kept, np.int64)
