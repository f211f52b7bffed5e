"""Pipelines of several operators: sliced detection, cascades, enhancement chains."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..operators import raster, slicing, suppression

#: order in which enhancement steps run
ENHANCEMENT_ORDER = ("low_light", "dehaze", "denoise", "super_resolution")


def crops(images: DataFrame, boxes: DataFrame, expand: float = 0.0, box_id: str = "det_id") -> DataFrame:
    """Images of boxes: image_id of the crop (a hash of image and box), parent, box_id and the image columns.

    The lateral join of an image with its boxes; boxes without a pixel are left out.
    """
    from ..functions import geometry

    roi = geometry.roi(F.struct("x1", "y1", "x2", "y2"), F.col("width"), F.col("height"), expand)
    rows = boxes.select("image_id", box_id, "x1", "y1", "x2", "y2").join(images.select("image_id", "width", "height", "channels", "data"), "image_id")
    rows = rows.withColumn("roi", roi).where("roi.width > 0 and roi.height > 0")
    line = F.expr("transform(sequence(roi.y, roi.y + roi.height - 1), y -> substring(data, (y * width + roi.x) * channels + 1, roi.width * channels))")
    joined = F.aggregate(line, F.lit(b""), lambda a, b: F.concat(a, b))
    return rows.select(F.xxhash64("image_id", box_id).alias("image_id"), F.col("image_id").alias("parent"), box_id, F.col("roi.width").alias("width"), F.col("roi.height").alias("height"), "channels", joined.alias("data"))


def cascade(images: DataFrame, boxes: DataFrame, stage: Callable[[DataFrame], DataFrame], expand: float = 0.0, box_id: str = "det_id") -> DataFrame:
    """A detector's boxes through a second model: boxes with the stage's columns, null where it found nothing."""
    parts = crops(images, boxes, expand, box_id).persist()
    found = stage(parts.drop("parent", box_id)).join(parts.select("image_id", "parent", box_id), "image_id").drop("image_id").withColumnRenamed("parent", "image_id")
    return boxes.join(found, ["image_id", box_id], "left")


def sliced_detection(images: DataFrame, predict: Callable[[DataFrame], DataFrame], size: int = 512, overlap: float = 0.2, merge: str = "greedy", metric: str = "ios", threshold: float = 0.5, exclude: tuple[int, ...] = (), full_image: bool = True, confidence: float = 0.5, force: bool = False) -> DataFrame:
    """Detections of overlapping slices and of the full image, brought together.

    predict takes images and returns image_id, class_id, score, x1..y2.  Excluded classes go first, then boxes
    are clipped against the full image's size, then moved to their slice's place.  merge is nms, greedy or
    transitive; below a confidence of 0.1 it is nms by IoU unless forced.
    """
    if merge not in ("nms", "greedy", "transitive"):
        raise InvalidArgument(merge)
    if confidence < 0.1 and not force and merge != "nms":
        merge, metric = "nms", "iou"
    sized = images.select("image_id", F.col("width").alias("w"), F.col("height").alias("h"))
    grid = slicing.slice_images(sized, size, overlap).select("image_id", "slice_no", *[F.col(a).cast("double").alias(b) for a, b in (("x_min", "x1"), ("y_min", "y1"), ("x_max", "x2"), ("y_max", "y2"))])
    parts = crops(images, grid, box_id="slice_no")
    places = grid.join(sized, "image_id").select(F.xxhash64("image_id", "slice_no").alias("part"), "image_id", "slice_no", F.col("x1").alias("dx"), F.col("y1").alias("dy"), "w", "h")
    found = predict(parts.drop("parent", "slice_no")).withColumnRenamed("image_id", "part").join(places, "part")
    wanted = lambda df: df.where(~F.col("class_id").isin(*exclude)) if exclude else df
    clip = lambda c, most: F.least(F.greatest(F.col(c), F.lit(0.0)), F.col(most).cast("double"))
    clipped = wanted(found).select("image_id", "slice_no", "class_id", "score", clip("x1", "w").alias("x1"), clip("y1", "h").alias("y1"), clip("x2", "w").alias("x2"), clip("y2", "h").alias("y2"), "dx", "dy").where("x1 < x2 and y1 < y2")
    moved = clipped.select("image_id", "slice_no", "class_id", "score", *[(F.col(c) + F.col(f"d{c[0]}")).alias(c) for c in ("x1", "y1", "x2", "y2")])
    if full_image:
        several = grid.groupBy("image_id").agg(F.max("slice_no").alias("last")).where("last > 0").select("image_id")
        whole = wanted(predict(images.join(several, "image_id", "left_semi")))
        moved = moved.unionByName(whole.select("image_id", F.lit(-1).alias("slice_no"), "class_id", "score", "x1", "y1", "x2", "y2"))
    seq = F.row_number().over(_order())
    rows = moved.withColumn("seq", seq)
    if merge == "nms":
        return suppression.suppress(rows, "slices", metric=metric, threshold=threshold)
    join = suppression.greedy_merge if merge == "greedy" else suppression.transitive_merge
    return join(rows, threshold=threshold, metric=metric)


def _order():
    from pyspark.sql import Window

    return Window.partitionBy("image_id").orderBy("slice_no", "class_id", F.desc("score"), "x1", "y1", "x2", "y2")


def enhance(images: DataFrame, steps: dict[str, Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """Any of the enhancement steps, in their order; at least one."""
    unknown = set(steps) - set(ENHANCEMENT_ORDER)
    if not steps or unknown:
        raise InvalidArgument(f"steps are some of {ENHANCEMENT_ORDER}")
    for name in ENHANCEMENT_ORDER:
        if name in steps:
            images = raster.map_images(images, steps[name])
    return images


def grounded_segmentation(boxes: DataFrame, masks: DataFrame, box_id: str = "det_id") -> DataFrame:
    """Boxes found by text (with their phrase) and the best of the masks prompted by each; null where there is none."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("image_id", box_id).orderBy(F.desc("mask_score"), "mask_no"))
    best = masks.withColumn("_place", place).where("_place = 1").select("image_id", box_id, "mask", "mask_score")
    return boxes.join(best, ["image_id", box_id], "left")


def boxes_of_masks(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Segmentations of slices as candidates for merging: their boxes are their masks', those without one go."""
    from ..operators.masks import box

    found = rows.where("mask is not null").withColumn("_box", box(F.col("mask"), threshold)).where("_box is not null")
    return found.drop("x1", "y1", "x2", "y2").select("*", *[F.col(f"_box.{c}").cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]).drop("_box")


def text_in_cells(cells: DataFrame, words: DataFrame, table: str = "table_id") -> DataFrame:
    """Cells (cell_no, x1..y2) with the words (x, y of their centres, text) inside them, in reading order."""
    inside = (F.col("x") >= F.col("x1")) & (F.col("x") < F.col("x2")) & (F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y2"))
    found = cells.join(words, table).where(inside).groupBy(table, "cell_no").agg(F.array_sort(F.collect_list(F.struct("y", "x", "text"))).alias("w"))
    return cells.join(found.select(table, "cell_no", F.array_join(F.transform("w", lambda s: s["text"]), " ").alias("text")), [table, "cell_no"], "left")
