"""The engines: what each expects of a model and its default values, and those whose results are further tables.

Engines that make an image's rows where the image is are in vision.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Unsupported
from ..functions import geometry, vectors
from ..operators import decode, planes, sequences, suppression
from .preprocess import PRESETS
from .scoring import output, score_images


@dataclass(frozen=True)
class Engine:
    """preset: how images become input; defaults: thresholds, limits and sizes."""

    name: str
    preset: str
    defaults: dict = field(default_factory=dict)


ENGINES: dict[str, Engine] = {
    e.name: e
    for e in (
        Engine("classification", "stretch_normalized", {"threshold": 0.5, "k": 5}),
        Engine("detection", "letterbox", {"threshold": 0.5, "iou": 0.45}),
        Engine("detection_end_to_end", "letterbox", {"threshold": 0.5}),
        Engine("detection_transformer", "stretch_normalized", {"threshold": 0.5, "most": 300}),
        Engine("segmentation", "letterbox", {"threshold": 0.5, "mask": 0.35}),
        Engine("open_vocabulary", "letterbox_plain", {"threshold": 0.01, "iou": 0.65}),
        Engine("concepts", "minus_half_1008", {"threshold": 0.1, "k": 1, "most_prompts": 16}),
        Engine("point_segmentation", "longest_side_1024", {"area": 200, "score": 0.5, "most": 30}),
        Engine("multi_mask_segmentation", "longest_side_1024", {"area": 200, "score": 0.3, "most": 30}),
        Engine("grounding", "grounding_800", {"box": 0.25, "text": 0.2}),
        Engine("grounded_segmentation", "grounding_800", {"box": 0.25, "text": 0.2}),
        Engine("foreground", "stretch_normalized", {"threshold": 0.5}),
        Engine("portrait_matting", "minus_one_to_one", {}),
        Engine("semantic_segmentation", "stretch_normalized", {}),
        Engine("human_parsing", "stretch_normalized", {"classes": 18}),
        Engine("depth", "stretch_normalized", {}),
        Engine("super_resolution", "style_raw", {"size": 384, "pad": 16, "scale": 4}),
        Engine("enhancement", "style_raw", {"size": 512, "pad": 32, "scale": 1}),
        Engine("enhancement_pipeline", "style_raw", {}),
        Engine("deblurring", "aligned", {"size": 0}),
        Engine("style_transfer", "style_raw", {"size": 0}),
        Engine("pose", "letterbox", {"threshold": 0.25, "iou": 0.45}),
        Engine("pose_one_stage", "letterbox_raw_bgr", {"threshold": 0.45, "iou": 0.65}),
        Engine("whole_body", "stretch_normalized", {"points": 133}),
        Engine("hand", "palm_192", {"threshold": 0.5, "iou": 0.3, "most": 4}),
        Engine("pose_rules", "", {"least": 0.3}),
        Engine("gesture", "", {"least_hit": 0.55}),
        Engine("action", "", {"frames": 30}),
        Engine("face_detection", "face_raw", {"threshold": 0.6, "iou": 0.3, "before": 5000}),
        Engine("face_recognition", "face_embedding", {}),
        Engine("face_attribute", "age_gender", {"expand": 0.2}),
        Engine("expression", "expression", {"expand": 0.2}),
        Engine("face_landmarks", "face_raw", {"points": 106, "expand": 0.2}),
        Engine("liveness", "stretch_normalized", {"threshold": 0.5}),
        Engine("reidentification", "stretch_normalized", {}),
        Engine("rotated_detection", "letterbox_plain", {"threshold": 0.5, "iou": 0.45}),
        Engine("text_recognition", "text_line", {"pixel": 0.3, "region": 0.5, "blank": 0}),
        Engine("plate", "plate_mean", {"threshold": 0.5, "iou": 0.4}),
        Engine("table", "table_488", {}),
        Engine("qr", "qr", {"threshold": 0.2, "iou": 0.45, "before": 100}),
        Engine("image_quality", "", {}),
        Engine("feature_matching", "shrink_gray", {"threshold": 0.0}),
        Engine("keypoint_features", "shrink_rgb_784", {"most": 2048}),
        Engine("mutual_matching", "shrink_gray", {"threshold": 0.1}),
        Engine("dense_matching", "stretch", {"threshold": 0.3, "stride": 16}),
    )
}

#: engines that have no prediction from one image alone
NOT_FROM_IMAGE = frozenset({"gesture", "action", "pose_rules", "point_segmentation", "multi_mask_segmentation", "grounding", "grounded_segmentation", "face_attribute", "expression", "feature_matching", "mutual_matching", "dense_matching"})


def spec_of(engine: str, **changes):
    from dataclasses import replace

    return replace(PRESETS[ENGINES[engine].preset], **changes)


def require_image(engine: str) -> None:
    if engine in NOT_FROM_IMAGE:
        raise Unsupported(f"{engine} predicts nothing from an image alone")


def classify(images: DataFrame, scorer, k: int = 5, threshold: float | None = 0.5, **changes) -> DataFrame:
    """image_id, rank, class_id, score."""
    scores = output(score_images(images, scorer, spec_of("classification", **changes))).select("image_id", F.col("f32").alias("scores"))
    return decode.from_scores(scores, k, threshold)


def detect(images: DataFrame, scorer, classes: int, threshold: float = 0.5, iou: float = 0.45, channel_major: bool = True, **changes) -> DataFrame:
    """image_id, anchor, class_id, score and x1..y2 in the image's pixels, clipped to it."""
    spec = spec_of("detection", **changes)
    raw = output(score_images(images, scorer, spec)).select("image_id", "f32")
    rows = decode.decode_centre_boxes(decode.anchors(raw, "f32", 4 + classes, channel_major), classes, "detection", threshold)
    kept = suppression.suppress(rows, "detection", order="anchor", threshold=iou)
    sizes = images.select("image_id", "width", "height", geometry.letterbox(F.col("width"), F.col("height"), spec.width, spec.height, spec.nudge).alias("fit"))
    back = kept.join(sizes, "image_id").withColumn("box", geometry.clip(geometry.restore(F.struct("x1", "y1", "x2", "y2"), F.col("fit")), F.col("width"), F.col("height")))
    return back.select("image_id", "anchor", "class_id", "score", "box.*")


def segment_classes(images: DataFrame, scorer, classes: int, **changes) -> DataFrame:
    """image_id, y, x, v: the class plane at the model's resolution."""
    raw = output(score_images(images, scorer, spec_of("semantic_segmentation", **changes)))
    n = F.size("f32") / classes
    at = F.sequence(F.lit(0), (n - 1).cast("int"))
    best = F.transform(at, lambda i: vectors.argmax(F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.element_at("f32", (c * n + i + 1).cast("int")))))
    width = F.element_at("shape", -1)
    return raw.select("image_id", width.alias("w"), F.posexplode(best).alias("i", "v")).select("image_id", F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).cast("int").alias("x"), "v")


def recognize_lines(lines: DataFrame, scorer, dictionary: DataFrame, blank: int = 0, **changes) -> DataFrame:
    """line_id, text and score of line images."""
    raw = output(score_images(lines, scorer, spec_of("text_recognition", **changes)))
    classes = F.element_at("shape", -1).cast("int")
    frames = F.transform(F.sequence(F.lit(0), (F.size("f32") / classes - 1).cast("int")), lambda t: F.slice("f32", t * classes + 1, classes))
    best = raw.select(F.col("image_id").alias("line_id"), F.posexplode(frames).alias("t", "v")).select("line_id", "t", vectors.argmax(F.col("v")).alias("best"), F.array_max("v").alias("prob"))
    return sequences.ctc_decode(best, blank, dictionary=dictionary)


def assess(images: DataFrame) -> DataFrame:
    """Quality of images without a model: gray values as arrays, then planes.image_quality."""
    from ..operators import raster

    gray = raster.map_images(images, lambda a: a if a.shape[2] == 1 else raster.convert_colour(a[..., :3], "bgr2gray"))
    data = F.expr("transform(sequence(1, length(data)), i -> cast(conv(hex(substring(data, i, 1)), 16, 10) as int))")
    return planes.image_quality(gray.where("error is null").select("image_id", "width", "height", data.alias("data"))).drop("data")
