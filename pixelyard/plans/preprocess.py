"""Images to model input: one parameterised stage for all engines."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from ..operators import raster

#: fixed values: means and deviations of the usual training set, for R, G, B in 0..1
IMAGENET = ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225))


@dataclass(frozen=True)
class PreprocessSpec:
    """How an image becomes channels x height x width.

    fit: stretch, letterbox (centred), corner (top left) or keep; shrink_only never enlarges; align rounds the
    size up to a multiple.  Values are (pixel * scale - mean) / std by channel; rgb turns B, G, R around;
    pad_first normalises the padding with the image, otherwise it stays `pad_value`.
    """

    width: int = 640
    height: int = 640
    fit: str = "stretch"
    kind: str = "bilinear"
    rgb: bool = True
    gray: bool = False
    scale: float = 1 / 255
    mean: tuple[float, ...] = (0.0, 0.0, 0.0)
    std: tuple[float, ...] = (1.0, 1.0, 1.0)
    pad_value: float = 0.0
    nudge: float = 0.1
    shrink_only: bool = False
    align: int = 1
    pad_first: bool = True
    limit: tuple[str, int] | None = None  # (max or min, side): the longer at most, or the shorter at least


def fit_of(spec: PreprocessSpec, width: int, height: int) -> tuple[int, int, int, int, int, int]:
    """New width and height, canvas width and height, left and top pad."""
    half = lambda v: int(np.floor(v + 0.5))
    if spec.limit is not None:
        how, side = spec.limit
        ratio = min(1.0, side / max(width, height)) if how == "max" else max(1.0, side / min(width, height))
        w, h = (max(32, half(v * ratio / 32) * 32) for v in (width, height))
        return w, h, w, h, 0, 0
    if spec.fit == "keep":
        w, h = (-(-v // spec.align) * spec.align for v in (width, height))
        return w, h, w, h, 0, 0
    if spec.fit == "stretch":
        return spec.width, spec.height, spec.width, spec.height, 0, 0
    ratio = min(spec.width / width, spec.height / height)
    ratio = min(ratio, 1.0) if spec.shrink_only else ratio
    w, h = max(1, half(width * ratio)), max(1, half(height * ratio))
    if spec.fit == "corner":
        return w, h, spec.width, spec.height, 0, 0
    return w, h, spec.width, spec.height, half((spec.width - w) / 2 - spec.nudge), half((spec.height - h) / 2 - spec.nudge)


def preprocess(image: np.ndarray, spec: PreprocessSpec) -> np.ndarray:
    """Channels x height x width in single precision."""
    image = np.repeat(image, 3, axis=2) if image.shape[2] == 1 else image[..., :3]
    w, h, canvas_w, canvas_h, left, top = fit_of(spec, image.shape[1], image.shape[0])
    if spec.gray:
        image = raster.convert_colour(image, "bgr2gray")
    small = raster.resize(image, w, h, spec.kind).astype(np.float32)
    mean, std = (np.array(v[: image.shape[2]], np.float32) for v in (spec.mean, spec.std))
    norm = lambda a: (a * np.float32(spec.scale) - mean) / std
    out = np.full((canvas_h, canvas_w, image.shape[2]), spec.pad_value, np.float32)
    if spec.rgb and not spec.gray:
        small = small[..., ::-1]
    if not spec.pad_first:
        small = norm(small)
    out[top : top + h, left : left + w] = small[: canvas_h - top, : canvas_w - left]
    return np.ascontiguousarray((norm(out) if spec.pad_first else out).transpose(2, 0, 1))


STRETCH = PreprocessSpec()
PRESETS: dict[str, PreprocessSpec] = {
    "stretch": STRETCH,
    "stretch_normalized": replace(STRETCH, mean=IMAGENET[0], std=IMAGENET[1]),
    "letterbox": replace(STRETCH, fit="letterbox", pad_value=114.0),
    "letterbox_plain": replace(STRETCH, fit="letterbox", pad_value=114.0, nudge=0.0),
    "letterbox_raw_bgr": replace(STRETCH, fit="letterbox", pad_value=114.0, rgb=False, scale=1.0),
    "shrink_gray": replace(STRETCH, fit="letterbox", shrink_only=True, gray=True, nudge=0.0),
    "shrink_rgb_784": replace(STRETCH, width=784, height=784, fit="letterbox", shrink_only=True, nudge=0.0),
    "longest_side_1024": replace(STRETCH, width=1024, height=1024, fit="corner", mean=IMAGENET[0], std=IMAGENET[1]),
    "text_detection": replace(STRETCH, limit=("max", 960), mean=IMAGENET[0], std=IMAGENET[1]),
    "text_line": replace(STRETCH, width=320, height=48, fit="corner", mean=(0.5, 0.5, 0.5), std=(0.5, 0.5, 0.5), pad_first=False),
    "table_488": replace(STRETCH, width=488, height=488, fit="corner", rgb=False, mean=IMAGENET[0], std=IMAGENET[1], pad_first=False),
    "plate_mean": replace(STRETCH, fit="letterbox", rgb=False, scale=1.0, mean=(104.0, 117.0, 123.0), nudge=0.0, pad_first=False),
    "plate_text": replace(STRETCH, width=94, height=24, rgb=False, scale=1.0, mean=(127.5, 127.5, 127.5), std=(128.0, 128.0, 128.0)),
    "face_raw": replace(STRETCH, rgb=False, scale=1.0, fit="corner"),
    "face_embedding": replace(STRETCH, width=112, height=112, scale=1.0),
    "age_gender": replace(STRETCH, width=62, height=62, rgb=False, scale=1.0),
    "expression": replace(STRETCH, width=64, height=64, gray=True, scale=1.0),
    "qr": replace(STRETCH, width=416, height=416, kind="cubic", gray=True),
    "minus_half_1008": replace(STRETCH, width=1008, height=1008, mean=(0.5, 0.5, 0.5)),
    "grounding_800": replace(STRETCH, width=800, height=800, mean=IMAGENET[0], std=IMAGENET[1]),
    "palm_192": replace(STRETCH, width=192, height=192),
    "aligned": replace(STRETCH, fit="keep", align=8),
    "style_raw": replace(STRETCH, fit="keep", scale=1.0),
    "minus_one_to_one": replace(STRETCH, scale=2 / 255, mean=(1.0, 1.0, 1.0)),
}
