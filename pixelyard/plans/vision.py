"""Engines that run: an image table, a model and its contract in, one row per finding out.

Each scores, decodes, filters and suppresses an image's candidates where the image is, in one Arrow stage
(scoring.predict): nothing is shuffled.  Models are passed in as scorers.  Boxes are in the image's pixels.
Rows of images that fail have only image_id and error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame

from ..errors import InvalidArgument
from ..functions.arrays import centre_boxes, clip_boxes, keep_boxes, sigmoid, sigmoid_if_needed, softmax, unfit
from ..operators import raster
from ..operators.masks import prototype_mask
from ..operators.suppression import may_overlap, rotated_iou
from .pipelines import crops
from .preprocess import PRESETS, PreprocessSpec
from .scoring import predict

BOX = "class_id int, score double, x1 double, y1 double, x2 double, y2 double"
MASK = "struct<width:int,height:int,data:array<float>>"
POINTS = "array<struct<x:float,y:float,score:float>>"


def spec_for(preset: str, **changes) -> PreprocessSpec:
    return replace(PRESETS[preset], **changes)


def first(outputs: dict[str, np.ndarray], number: int = 0) -> np.ndarray:
    values = list(outputs.values())
    if number >= len(values):
        raise InvalidArgument(f"the model has {len(values)} outputs")
    return np.asarray(values[number], np.float64)


def by_rows(raw: np.ndarray, channels: int) -> np.ndarray:
    """A row per anchor, whichever way the output lies."""
    if raw.ndim != 2 or channels not in raw.shape:
        raise InvalidArgument(f"an output of shape {raw.shape} has no {channels} channels")
    return raw if raw.shape[1] == channels and raw.shape[0] != channels else raw.T


def points_of(values: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y), "score": float(s)} for x, y, s in values]


def found_boxes(rows: np.ndarray, classes: int, threshold: float, iou: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, classes, scores and boxes of the anchors (cx, cy, w, h, class scores, ...) that stay."""
    scores = rows[:, 4 : 4 + classes]
    label, score = scores.argmax(axis=1), scores.max(axis=1)
    sure = np.flatnonzero((score >= threshold) & (score > 0))
    boxes = centre_boxes(rows[sure, :4])
    kept = keep_boxes(boxes, score[sure], iou, label[sure])
    return sure[kept], label[sure[kept]], score[sure[kept]], boxes[kept]


def segment(images: DataFrame, scorer: Callable, classes: int, coefficients: int = 32, threshold: float = 0.5, iou: float = 0.45, **changes) -> DataFrame:
    """class_id, score, box and mask (width, height and values of the whole image) of each instance.

    Outputs: [4 + classes + coefficients, anchors] and prototypes [coefficients, h, w].  Only what survives is decoded.
    """
    spec = spec_for("letterbox", **changes)

    def finish(outputs, width, height):
        rows, prototypes = by_rows(first(outputs), 4 + classes + coefficients), first(outputs, 1)
        number, label, score, boxes = found_boxes(rows, classes, threshold, iou)
        out = []
        for n, c, s, box in zip(number, label, score, clip_boxes(unfit(boxes, spec, width, height), width, height)):
            mask = prototype_mask(rows[n, 4 + classes :], prototypes, spec, width, height, tuple(box))
            out.append((int(c), float(s), *map(float, box), {"width": width, "height": height, "data": mask.ravel().tolist()}))
        return out

    return predict(images, scorer, spec, finish, f"{BOX}, mask {MASK}")


def poses(images: DataFrame, scorer: Callable, points: int = 17, classes: int = 1, threshold: float = 0.25, iou: float = 0.45, **changes) -> DataFrame:
    """class_id, score, box and keypoints.  Output: [4 + classes + 3 * points, anchors]; scores of points outside 0..1 get a sigmoid."""
    spec = spec_for("letterbox", **changes)

    def finish(outputs, width, height):
        rows = by_rows(first(outputs), 4 + classes + 3 * points)
        number, label, score, boxes = found_boxes(rows, classes, threshold, iou)
        out = []
        for n, c, s, box in zip(number, label, score, clip_boxes(unfit(boxes, spec, width, height), width, height)):
            k = rows[n, 4 + classes :].reshape(points, 3).copy()
            k[:, :2] = unfit(np.tile(k[:, :2], 2), spec, width, height)[:, :2]
            outside = (k[:, 2] < 0) | (k[:, 2] > 1)
            k[outside, 2] = sigmoid(k[outside, 2])
            out.append((int(c), float(s), *map(float, box), points_of(k)))
        return out

    return predict(images, scorer, spec, finish, f"{BOX}, points {POINTS}")


def rotated(images: DataFrame, scorer: Callable, classes: int, threshold: float = 0.5, iou: float = 0.45, **changes) -> DataFrame:
    """class_id, score, cx, cy, w, h, angle.  Output: [4 + classes + 1, anchors], the angle last; suppression is by polygons, whatever the class."""
    spec = spec_for("letterbox_plain", **changes)

    def finish(outputs, width, height):
        rows = by_rows(first(outputs), 5 + classes)
        scores = rows[:, 4 : 4 + classes]
        label, score = scores.argmax(axis=1), scores.max(axis=1)
        kept: list[tuple[int, tuple[float, ...]]] = []
        for n in sorted(np.flatnonzero(score >= threshold), key=lambda i: (-score[i], i)):
            box = (*rows[n, :4], rows[n, -1])
            if not any(may_overlap(k, box, iou) and rotated_iou(k, box) > iou for _, k in kept):
                kept.append((n, box))
        out = []
        for n, (cx, cy, w, h, angle) in kept:
            x1, y1, x2, y2 = unfit(np.array([[cx, cy, cx + w, cy + h]]), spec, width, height)[0]
            out.append((int(label[n]), float(score[n]), float(x1), float(y1), float(x2 - x1), float(y2 - y1), float(angle)))
        return out

    return predict(images, scorer, spec, finish, "class_id int, score double, cx double, cy double, w double, h double, angle double")


def faces(images: DataFrame, scorer: Callable, threshold: float = 0.6, iou: float = 0.3, before: int = 5000, strides: tuple[int, ...] = (8, 16, 32), **changes) -> DataFrame:
    """score, box and five landmarks.

    Outputs: one of rows x, y, w, h, ten landmark numbers, score; or for each stride a class, an object, a box
    and a landmark head, all heads of one kind together, over the stride's grid in the padded input.
    """
    spec = spec_for("face_raw", **changes)

    def heads(outputs) -> np.ndarray:
        if len(outputs) < 4 * len(strides):
            return first(outputs).reshape(-1, 15)
        out = []
        for i, stride in enumerate(strides):
            columns, lines = spec.width // stride, spec.height // stride
            cls, obj, box, marks = (first(outputs, i + k * len(strides)).reshape(columns * lines, -1) for k in range(4))
            grid = np.stack([np.tile(np.arange(columns), lines), np.repeat(np.arange(lines), columns)], axis=1)
            centre, size = (grid + box[:, :2]) * stride, np.exp(box[:, 2:]) * stride
            score = np.sqrt(np.clip(cls, 0, 1) * np.clip(obj, 0, 1))
            out.append(np.hstack([centre - size / 2, size, (marks + np.tile(grid, 5)) * stride, score]))
        return np.concatenate(out)

    def finish(outputs, width, height):
        rows = heads(outputs)
        rows = rows[rows[:, 14] >= threshold]
        rows = rows[np.argsort(-rows[:, 14], kind="stable")][:before]
        boxes = np.hstack([rows[:, :2], rows[:, :2] + rows[:, 2:4]])
        out = []
        for n in keep_boxes(boxes, rows[:, 14], iou):
            box = clip_boxes(unfit(boxes[n : n + 1], spec, width, height), width, height)[0]
            marks = unfit(np.tile(rows[n, 4:14].reshape(5, 2), 2), spec, width, height)[:, :2]
            out.append((float(rows[n, 14]), *map(float, box), points_of(np.column_stack([marks, np.full(5, rows[n, 14])]))))
        return out

    return predict(images, scorer, spec, finish, f"score double, x1 double, y1 double, x2 double, y2 double, points {POINTS}")


def keypoints(images: DataFrame, scorer: Callable, points: int, preset: str = "stretch_normalized", split: float = 2.0, **changes) -> DataFrame:
    """points of one subject an image, by its two axes.  Outputs: bins along x and along y, [points, bins] each."""
    spec = spec_for(preset, **changes)

    def finish(outputs, width, height):
        x, y = (first(outputs, k).reshape(points, -1) for k in (0, 1))
        at = np.stack([x.argmax(axis=1) / split, y.argmax(axis=1) / split], axis=1)
        back = unfit(np.tile(at, 2), spec, width, height)[:, :2]
        return [(points_of(np.column_stack([back, np.minimum(x.max(axis=1), y.max(axis=1))])),)]

    return predict(images, scorer, spec, finish, f"points {POINTS}")


def embeddings(images: DataFrame, scorer: Callable, preset: str = "stretch_normalized", **changes) -> DataFrame:
    """embedding: the first output at unit length (a zero vector stays)."""

    def finish(outputs, width, height):
        v = first(outputs).ravel()
        return [((v / (np.linalg.norm(v) or 1.0)).tolist(),)]

    return predict(images, scorer, spec_for(preset, **changes), finish, "embedding array<float>")


def depth(images: DataFrame, scorer: Callable, **changes) -> DataFrame:
    """width, height and values from 0 (far) to 1 (near) at the image's size; a plane of one value is 0."""

    def finish(outputs, width, height):
        plane = first(outputs)
        plane = raster.resample(plane.reshape(plane.shape[-2:]), width, height)
        low, high = plane.min(), plane.max()
        return [(width, height, ((plane - low) / (high - low) if high > low else plane * 0).ravel().tolist())]

    return predict(images, scorer, spec_for("stretch_normalized", **changes), finish, "width int, height int, values array<float>")


def alphas(images: DataFrame, scorer: Callable, preset: str = "stretch_normalized", **changes) -> DataFrame:
    """width, height and values: how much of each pixel is foreground, at the image's size.

    Output: one plane, through a sigmoid if it leaves 0..1 by far, or two, whose second's share by softmax it is.
    """

    def finish(outputs, width, height):
        planes = first(outputs)
        planes = planes.reshape(-1, *planes.shape[-2:])
        if len(planes) == 2:
            share = softmax(planes, axis=0)[1]
        else:
            share = sigmoid(np.clip(planes[0], -20, 20)) if planes[0].max() > 1.5 or planes[0].min() < -0.01 else np.clip(planes[0], 0, 1)
        return [(width, height, np.clip(raster.resample(share, width, height), 0, 1).ravel().tolist())]

    return predict(images, scorer, spec_for(preset, **changes), finish, "width int, height int, values array<float>")


def classes_by_pixel(images: DataFrame, scorer: Callable, classes: int, preset: str = "stretch_normalized", **changes) -> DataFrame:
    """width, height, values (the class of each pixel, nearest up to the image's size) and shares of all classes at the model's."""

    def finish(outputs, width, height):
        planes = first(outputs)
        best = planes.reshape(classes, *planes.shape[-2:]).argmax(axis=0)
        full = best[(np.arange(height) * best.shape[0] // height)[:, None], np.arange(width) * best.shape[1] // width]
        return [(width, height, full.ravel().tolist(), (np.bincount(best.ravel(), minlength=classes) / best.size).tolist())]

    return predict(images, scorer, spec_for(preset, **changes), finish, "width int, height int, values array<int>, shares array<double>")


def lines_of_text(images: DataFrame, scorer: Callable, dictionary: list[str], blank: int = 0, preset: str = "text_line", **changes) -> DataFrame:
    """text and score (the mean of its characters', 0 for none).  Output: [steps, classes]; class k is dictionary[k - 1] after a blank of 0, else dictionary[k]."""

    def finish(outputs, width, height):
        steps = first(outputs)
        best, sure = steps.argmax(axis=1), steps.max(axis=1)
        new = np.concatenate([[True], best[1:] != best[:-1]]) & (best != blank)
        named = [(k - 1 if blank == 0 else k, s) for k, s in zip(best[new].tolist(), sure[new].tolist())]
        named = [(dictionary[k], s) for k, s in named if k < len(dictionary)]
        return [("".join(c for c, _ in named), float(np.mean([s for _, s in named])) if named else 0.0)]

    return predict(images, scorer, spec_for(preset, **changes), finish, "text string, score double")


def text_regions(images: DataFrame, scorer: Callable, pixel: float = 0.3, region: float = 0.5, least_side: int = 3, most: int = 1000, **changes) -> DataFrame:
    """box_no, score and box of each region of text, in reading order.

    Regions are the 8-connected components, in the order of their first pixel and `most` at most, of what exceeds
    `pixel`; those narrower than least_side or of a mean below `region` go.  Read by the middle of their left
    edge, from top to bottom, then from left to right.
    """
    spec = spec_for("text_detection", **changes)

    def finish(outputs, width, height):
        plane = first(outputs)
        plane = plane.reshape(plane.shape[-2:])
        found = []
        for y, x in raster.regions(plane > pixel)[:most]:
            x1, y1, x2, y2 = x.min(), y.min(), x.max() + 1, y.max() + 1
            score = plane[y, x].mean()
            if min(x2 - x1, y2 - y1) >= least_side and score >= region:
                sx, sy = width / plane.shape[1], height / plane.shape[0]
                found.append((float(score), x1 * sx, y1 * sy, x2 * sx, y2 * sy))
        found.sort(key=lambda r: ((r[2] + r[4]) / 2, r[1]))
        return [(k, s, *map(float, box)) for k, (s, *box) in enumerate(found)]

    return predict(images, scorer, spec, finish, "box_no int, score double, x1 double, y1 double, x2 double, y2 double")


def read_text(images: DataFrame, regions: Callable, lines: Callable, dictionary: list[str], blank: int = 0, expand: float = 0.0) -> DataFrame:
    """Regions of text and what they read: image_id, box_no, box, text, score; text is null where reading failed."""
    boxes = text_regions(images, regions).where("error is null").drop("error", "score")
    return through(images, boxes, lambda parts: lines_of_text(parts, lines, dictionary, blank), "box_no", expand)


def through(images: DataFrame, boxes: DataFrame, engine: Callable[[DataFrame], DataFrame], box_id: str, expand: float = 0.0) -> DataFrame:
    """A detector's boxes with an engine's findings on each one's part of the image; null where it found nothing.

    The usual second stages: faces to attributes, landmarks, liveness or embeddings; persons to embeddings or
    whole-body points; plates and regions to text.
    """
    parts = crops(images, boxes, expand, box_id)
    found = engine(parts.drop("parent", box_id)).drop("error")
    names = parts.select("image_id", "parent", box_id)
    return boxes.join(found.join(names, "image_id").drop("image_id").withColumnRenamed("parent", "image_id"), ["image_id", box_id], "left")


def enhance_by_model(images: DataFrame, scorer: Callable, size: int = 384, pad: int = 16, scale: int = 1, rgb: bool = True, unit: bool = True) -> DataFrame:
    """Images through an image-to-image model, tile by tile (size 0: at once): super-resolution, denoising, low light, haze, blur, style.

    The model takes and gives [3, h, w] in 0..1 (unit) or 0..255, the result `scale` times as large.
    """

    def kernel_of(model):
        def kernel(tile: np.ndarray) -> np.ndarray:
            x = (tile[..., 2::-1] if rgb else tile[..., :3]).astype(np.float32).transpose(2, 0, 1) / (255 if unit else 1)
            y = np.asarray(model(np.ascontiguousarray(x)[None])[0][1][0], np.float64).transpose(1, 2, 0) * (255 if unit else 1)
            if y.shape[:2] != (tile.shape[0] * scale, tile.shape[1] * scale):
                raise InvalidArgument(f"a tile of {tile.shape[:2]} became {y.shape[:2]}")
            return raster.byte(y[..., ::-1] if rgb else y)

        return kernel

    held: list = []  # the worker's session

    def enhanced(image: np.ndarray) -> np.ndarray:
        if not held:
            held.append(scorer())
        return raster.tiled(image[..., :3], kernel_of(held[0]), size, pad, scale)

    return raster.map_images(images, enhanced)


#: engines by name: what runs them, and what they set
ASSEMBLED: dict[str, tuple[Callable, dict]] = {
    "segmentation": (segment, {}),
    "pose": (poses, {}),
    "rotated_detection": (rotated, {}),
    "face_detection": (faces, {}),
    "face_recognition": (embeddings, {"preset": "face_embedding"}),
    "reidentification": (embeddings, {}),
    "whole_body": (keypoints, {"points": 133}),
    "hand": (keypoints, {"points": 21}),
    "depth": (depth, {}),
    "foreground": (alphas, {}),
    "portrait_matting": (alphas, {"preset": "minus_one_to_one"}),
    "human_parsing": (classes_by_pixel, {"classes": 18}),
    "text_regions": (text_regions, {}),
    "text_recognition": (lines_of_text, {}),
    "plate_text": (lines_of_text, {"preset": "plate_text"}),
    "super_resolution": (enhance_by_model, {"size": 384, "pad": 16, "scale": 4}),
    "enhancement": (enhance_by_model, {"size": 512, "pad": 32}),
    "deblurring": (enhance_by_model, {"size": 0}),
    "style_transfer": (enhance_by_model, {"size": 0, "unit": False}),
}


def create(name: str, scorer: Callable, **options) -> Callable[[DataFrame], DataFrame]:
    """An engine by its name, as a function of an image table."""
    if name not in ASSEMBLED:
        raise InvalidArgument(f"{name} is none of {sorted(ASSEMBLED)}")
    engine, given = ASSEMBLED[name]
    return lambda images: engine(images, scorer, **(given | options))
