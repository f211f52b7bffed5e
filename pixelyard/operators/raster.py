"""Kernels over whole images, and the operator that applies one to an image table.

A kernel takes and returns an array of height x width x channels, 8 bits, in B, G, R (, A) order.  Images
stream through Arrow batches in the partitions they are in; nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import InvalidArgument

Kernel = Callable[[np.ndarray], np.ndarray]


def unpack(width: int, height: int, channels: int, data: bytes) -> np.ndarray:
    if len(data) != width * height * channels:
        raise InvalidArgument(f"{len(data)} bytes aren't {width} x {height} x {channels}")
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def byte(x: np.ndarray) -> np.ndarray:
    """Rounded (halves away from zero) and kept within 0 and 255."""
    return np.clip(np.floor(np.asarray(x, np.float64) + 0.5), 0, 255).astype(np.uint8)


#: channel conversions: channels they take, and what they do
CONVERSIONS: dict[str, tuple[int, Kernel]] = {
    "bgr2rgb": (3, lambda a: a[..., ::-1]),
    "rgb2bgr": (3, lambda a: a[..., ::-1]),
    "bgra2bgr": (4, lambda a: a[..., :3]),
    "bgra2rgb": (4, lambda a: a[..., 2::-1]),
    "gray2bgr": (1, lambda a: np.repeat(a, 3, axis=2)),
    "gray2rgb": (1, lambda a: np.repeat(a, 3, axis=2)),
    "bgr2gray": (3, lambda a: byte(np.float32(0.299) * a[..., 2:3] + np.float32(0.587) * a[..., 1:2] + np.float32(0.114) * a[..., 0:1])),
    "bgra2gray": (4, lambda a: byte(np.float32(0.299) * a[..., 2:3] + np.float32(0.587) * a[..., 1:2] + np.float32(0.114) * a[..., 0:1])),
}


def convert_colour(image: np.ndarray, code: str) -> np.ndarray:
    channels, change = CONVERSIONS[code]
    if image.shape[2] != channels:
        raise InvalidArgument(f"{code} takes {channels} channels, not {image.shape[2]}")
    return change(image)


def taps(old: int, new: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """For each new pixel the old ones it is made of and their weights, centres half a pixel in."""
    centre = (np.arange(new) + 0.5) * old / new - 0.5
    if kind == "nearest":
        return np.clip(np.floor((np.arange(new) + 0.5) * old / new).astype(int), 0, old - 1)[:, None], np.ones((new, 1))
    if kind == "area" and new < old:
        edges = np.arange(new + 1) * old / new
        most = math.ceil(old / new) + 1
        at = np.floor(edges[:-1]).astype(int)[:, None] + np.arange(most)
        weight = np.clip(np.minimum(at + 1, edges[1:, None]) - np.maximum(at, edges[:-1, None]), 0, 1)
        return np.clip(at, 0, old - 1), weight / weight.sum(axis=1, keepdims=True)
    if kind == "cubic":
        base = np.floor(centre).astype(int)
        x = np.abs(centre[:, None] - (base[:, None] + np.arange(-1, 3)))
        weight = np.where(x <= 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))
        return np.clip(base[:, None] + np.arange(-1, 3), 0, old - 1), weight
    base = np.floor(centre).astype(int)
    share = centre - base
    return np.clip(base[:, None] + np.arange(2), 0, old - 1), np.stack([1 - share, share], axis=1)


def resample(plane: np.ndarray, width: int, height: int, kind: str = "bilinear") -> np.ndarray:
    """Any array of height x width (x channels) at a new size, in floating point."""
    (rows, rw), (columns, cw) = taps(plane.shape[0], height, kind), taps(plane.shape[1], width, kind)
    out = np.asarray(plane, np.float64)
    out = np.einsum("hk...,hk->h...", out[rows], rw)
    out = np.moveaxis(out, 1, 0)
    return np.moveaxis(np.einsum("wk...,wk->w...", out[columns], cw), 0, 1)


def resize(image: np.ndarray, width: int, height: int, kind: str = "bilinear") -> np.ndarray:
    return image.copy() if image.shape[:2] == (height, width) else byte(resample(image, width, height, kind))


def resize_within(image: np.ndarray, width: int, height: int, kind: str = "bilinear") -> np.ndarray:
    """No larger than width x height with its shape kept, and never enlarged."""
    scale = min(width / image.shape[1], height / image.shape[0], 1.0)
    return resize(image, max(1, round(image.shape[1] * scale)), max(1, round(image.shape[0] * scale)), kind)


def border(image: np.ndarray, top: int, bottom: int, left: int, right: int, value: int | None = None) -> np.ndarray:
    """Padded with a value, or (None) with the edge's pixels."""
    pads = ((top, bottom), (left, right), (0, 0))
    return np.pad(image, pads, mode="edge") if value is None else np.pad(image, pads, constant_values=value)


def crop(image: np.ndarray, x: int, y: int, width: int, height: int) -> np.ndarray:
    if x < 0 or y < 0 or width < 0 or height < 0 or x + width > image.shape[1] or y + height > image.shape[0]:
        raise InvalidArgument("the rectangle leaves the image")
    return image[y : y + height, x : x + width]


def paste(image: np.ndarray, patch: np.ndarray, x: int, y: int) -> np.ndarray:
    """The image with the patch's visible part on it; unchanged if channels differ."""
    out = image.copy()
    if image.shape[2] == patch.shape[2]:
        x0, y0 = max(x, 0), max(y, 0)
        x1, y1 = min(x + patch.shape[1], image.shape[1]), min(y + patch.shape[0], image.shape[0])
        if x0 < x1 and y0 < y1:
            out[y0:y1, x0:x1] = patch[y0 - y : y1 - y, x0 - x : x1 - x]
    return out


def structuring_element(shape: str, width: int, height: int) -> np.ndarray:
    """rect, cross or ellipse as a boolean array."""
    cy, cx = height // 2, width // 2
    y, x = np.mgrid[:height, :width]
    if shape == "rect":
        return np.ones((height, width), bool)
    if shape == "cross":
        return (y == cy) | (x == cx)
    return ((x - cx) / max(cx, 0.5)) ** 2 + ((y - cy) / max(cy, 0.5)) ** 2 <= 1


def morphology(image: np.ndarray, kind: str, element: np.ndarray) -> np.ndarray:
    """erode, dilate, open or close; pixels beyond the border are 0."""
    if kind in ("open", "close"):
        first, second = ("erode", "dilate") if kind == "open" else ("dilate", "erode")
        return morphology(morphology(image, first, element), second, element)
    kh, kw = element.shape
    padded = np.pad(image, ((kh // 2, kh - 1 - kh // 2), (kw // 2, kw - 1 - kw // 2), (0, 0)))
    windows = [padded[dy : dy + image.shape[0], dx : dx + image.shape[1]] for dy, dx in np.argwhere(element)]
    return (np.minimum if kind == "erode" else np.maximum).reduce(windows)


def box_blur(image: np.ndarray) -> np.ndarray:
    """Mean of 3 x 3 neighbours, fewer at the edge."""
    ones = np.pad(np.ones(image.shape[:2] + (1,)), ((1, 1), (1, 1), (0, 0)))
    wide = np.pad(image.astype(np.float64), ((1, 1), (1, 1), (0, 0)))
    total = lambda a: sum(a[dy : dy + image.shape[0], dx : dx + image.shape[1]] for dy in range(3) for dx in range(3))
    return byte(total(wide) / total(ones))


def sample(image: np.ndarray, x: np.ndarray, y: np.ndarray, outside: int | None = None) -> np.ndarray:
    """Bilinear values at points; beyond the edge the edge's pixel, or `outside`."""
    h, w = image.shape[:2]
    cx, cy = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(cx).astype(int), np.floor(cy).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (cx - x0)[..., None], (cy - y0)[..., None]
    a = np.asarray(image, np.float64)
    out = (a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy
    if outside is not None:
        out[(x < 0) | (y < 0) | (x > w - 1) | (y > h - 1)] = outside
    return out


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """The 3 x 3 matrix that takes four source points to four target points; None if there is none."""
    rows = []
    for (x, y), (u, v) in zip(np.asarray(source, float), np.asarray(target, float)):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
    system, right = np.array(rows), np.asarray(target, float).ravel()
    if abs(np.linalg.det(system)) < 1e-10:
        return None
    return np.append(np.linalg.solve(system, right), 1.0).reshape(3, 3)


def warp_quad(image: np.ndarray, corners: np.ndarray, width: int, height: int) -> np.ndarray | None:
    """The quadrilateral (clockwise from top left) as an upright image."""
    back = homography(np.array([[0, 0], [width, 0], [width, height], [0, height]]), corners)
    if back is None:
        return None
    y, x = np.mgrid[:height, :width] + 0.5
    u, v, w = np.einsum("ij,jhw->ihw", back, np.stack([x, y, np.ones_like(x)]))
    return byte(sample(image, u / w - 0.5, v / w - 0.5))


def warp_similarity(image: np.ndarray, a: float, b: float, tx: float, ty: float, width: int, height: int) -> np.ndarray:
    """The image under (ax - by + tx, bx + ay + ty), as width x height."""
    y, x = np.mgrid[:height, :width].astype(float)
    scale = a * a + b * b
    dx, dy = x - tx, y - ty
    return byte(sample(image, (a * dx + b * dy) / scale, (a * dy - b * dx) / scale))


def rasterize(polygon: list[tuple[float, float]], width: int, height: int) -> np.ndarray:
    """Pixels whose centre lies in the polygon, by the even-odd rule."""
    y, x = np.mgrid[:height, :width] + 0.5
    inside = np.zeros((height, width), bool)
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]):
        if ay != by:
            inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return inside


def regions(plane: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """y and x of the pixels of each 8-connected component of a boolean plane, in the order of their first pixels.

    Runs of a row are joined with the runs they touch in the row above, so Python sees runs, not pixels.
    """
    edge = np.diff(np.pad(plane, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, start = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1]
    above = list(range(len(rows)))

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    begin = np.searchsorted(rows, np.arange(plane.shape[0] + 1)).tolist()
    for y in range(1, plane.shape[0]):
        i, j = begin[y - 1], begin[y]
        while i < begin[y] and j < begin[y + 1]:
            if start[i] <= stop[j] and start[j] <= stop[i]:
                a, b = top(i), top(j)
                above[max(a, b)] = min(a, b)
            if stop[i] < stop[j]:
                i += 1
            else:
                j += 1
    found: dict[int, list[int]] = {}
    for i in range(len(rows)):
        found.setdefault(top(i), []).append(i)
    out = []
    for runs in found.values():
        size = stop[runs] - start[runs]
        x = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[runs], size)
        out.append((np.repeat(rows[runs], size), x))
    return out


def cutout(image: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """B, G, R with alpha (0 to 1) as the fourth channel."""
    return np.concatenate([image[..., :3], byte(np.clip(alpha, 0, 1) * 255)[..., None]], axis=2)


def on_checkerboard(image: np.ndarray, block: int = 16) -> np.ndarray:
    """A four-channel image over light and dark tiles."""
    block = block if block >= 2 else 16
    y, x = np.mgrid[: image.shape[0], : image.shape[1]] // block
    ground = np.where((x + y) % 2 == 0, 200.0, 80.0)[..., None]
    share = image[..., 3:4] / 255.0
    return byte(image[..., :3] * share + ground * (1 - share))


def tiles(image: np.ndarray, size: int, pad: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """x, y and image of tiles side by side, each with `pad` replicated or neighbouring pixels around it."""
    wide = border(image, pad, pad, pad, pad)
    for y in range(0, image.shape[0], size):
        for x in range(0, image.shape[1], size):
            yield x, y, wide[y : min(y + size, image.shape[0]) + 2 * pad, x : min(x + size, image.shape[1]) + 2 * pad]


def tiled(image: np.ndarray, kernel: Kernel, size: int = 384, pad: int = 16, scale: int = 1) -> np.ndarray:
    """A kernel applied tile by tile (size 0: at once), its margins cut off, and put together `scale` times as large."""
    if size <= 0:
        return kernel(image)
    out = np.zeros((image.shape[0] * scale, image.shape[1] * scale, image.shape[2]), np.uint8)
    for x, y, tile in tiles(image, size, pad):
        done = kernel(tile)[pad * scale : (tile.shape[0] - pad) * scale, pad * scale : (tile.shape[1] - pad) * scale]
        out[y * scale : y * scale + done.shape[0], x * scale : x * scale + done.shape[1]] = done
    return out


def map_images(images: DataFrame, kernel: Kernel, strict: bool = False) -> DataFrame:
    """The image table with the kernel applied; where it fails, data is null and `error` says why (strict: raised)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                try:
                    done = np.ascontiguousarray(kernel(unpack(r["width"], r["height"], r["channels"], r["data"])))
                    out.append((r["image_id"], done.shape[1], done.shape[0], done.shape[2], done.tobytes(), None))
                except Exception as e:  # noqa: BLE001
                    if strict:
                        raise
                    out.append((r["image_id"], None, None, None, None, f"{type(e).__name__}: {e}"))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], ["image_id", "width", "height", "channels", "data", "error"])

    return images.select("image_id", "width", "height", "channels", "data").mapInArrow(apply, "image_id long, width int, height int, channels int, data binary, error string")
