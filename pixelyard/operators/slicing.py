"""Grids over images: slices, tiles, prompts and priors.  All closed forms over generated sequences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def steps(length: Column, size: Column, overlap: Column) -> Column:
    """Starts of windows of `size` along `length`, the last one moved back to the end."""
    room = F.greatest(length - size, F.lit(0))
    count = F.ceil(room / F.greatest(size - overlap, F.lit(1))).cast("int")
    return F.transform(F.sequence(F.lit(0), count), lambda i: F.least(i * (size - overlap), room).cast("int"))


def slice_grid(images: DataFrame, slice_h: Column | int, slice_w: Column | int, overlap_h: Column | int, overlap_w: Column | int, image: str = "image_id", height: str = "h", width: str = "w") -> DataFrame:
    """image, slice_no, x_min, y_min, x_max, y_max: overlapping windows row by row."""
    as_column = lambda x: F.lit(x) if isinstance(x, int) else x
    slice_h, slice_w, overlap_h, overlap_w = map(as_column, (slice_h, slice_w, overlap_h, overlap_w))
    ys, xs = steps(F.col(height), slice_h, overlap_h), steps(F.col(width), slice_w, overlap_w)
    grid = images.select(image, height, width, slice_h.alias("sh"), slice_w.alias("sw"), xs.alias("xs"), F.posexplode(ys).alias("row", "y_min"))
    grid = grid.select(image, height, width, "sh", "sw", "row", "y_min", F.size("xs").alias("columns"), F.posexplode("xs").alias("column", "x_min"))
    return grid.select(
        image,
        (F.col("row") * F.col("columns") + F.col("column")).alias("slice_no"),
        "x_min",
        "y_min",
        F.least(F.col("x_min") + F.col("sw"), F.col(width)).cast("int").alias("x_max"),
        F.least(F.col("y_min") + F.col("sh"), F.col(height)).cast("int").alias("y_max"),
    )


def slice_images(images: DataFrame, size: int = 512, overlap: float = 0.2, **names: str) -> DataFrame:
    """slice_grid with square slices and one overlap, as a share of the size."""
    if not 0 <= overlap < 1:
        raise ValueError("the overlap must be below 1")
    return slice_grid(images, size, size, int(overlap * size), int(overlap * size), **names)


def auto_slice_params(images: DataFrame, height: str = "h", width: str = "w") -> DataFrame:
    """Adds x_overlap, y_overlap, slice_w and slice_h that fit an image's resolution."""
    pixels = F.col(height).cast("long") * F.col(width).cast("long")
    factor = F.ceil(F.log2(pixels.cast("double"))) - 1
    level = F.when(factor <= 18, 0).when(factor < 21, 1).when(factor < 24, 2).otherwise(4)
    share = F.when(level == 0, 1.0).when(level == 1, 0.8).otherwise(0.4)
    columns = F.when(level == 0, 1).when(F.col(width) > F.col(height), level * 2).otherwise(level)
    rows = F.when(level == 0, 1).when(F.col(width) < F.col(height), level * 2).otherwise(level)
    sized = images.withColumn("slice_w", F.floor(F.col(width) / columns).cast("int")).withColumn("slice_h", F.floor(F.col(height) / rows).cast("int"))
    return sized.withColumn("x_overlap", F.floor(F.col("slice_w") * share).cast("int")).withColumn("y_overlap", F.floor(F.col("slice_h") * share).cast("int"))


def tile_grid(images: DataFrame, tile: int = 1008, stride: float = 0.85, least: int = 200, image: str = "image_id", height: str = "h", width: str = "w") -> DataFrame:
    """image, x, y, w, h of tiles at fixed strides; a side below `least` is skipped, small images are one tile."""
    step = int(tile * stride)
    starts = lambda length: F.when(F.greatest(height, width) > tile, F.sequence(F.lit(0), length - 1, F.lit(step))).otherwise(F.array(F.lit(0)))
    grid = images.select(image, height, width, F.explode(starts(F.col(height))).alias("y"), starts(F.col(width)).alias("xs")).select("*", F.explode("xs").alias("x"))
    sized = grid.withColumn("tw", F.least(F.lit(tile), F.col(width) - F.col("x"))).withColumn("th", F.least(F.lit(tile), F.col(height) - F.col("y")))
    big = F.greatest(height, width) > tile
    return sized.where(~big | ((F.col("tw") >= least) & (F.col("th") >= least))).select(image, "x", "y", F.col("tw").cast("int").alias("tile_w"), F.col("th").cast("int").alias("tile_h"))


def prompt_grid(images: DataFrame, step: int, image: str = "image_id", height: str = "h", width: str = "w") -> DataFrame:
    """Points at every `step` pixels inside the image."""
    axis = lambda length: F.when(length > step, F.sequence(F.lit(step), length - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return images.select(image, width, F.explode(axis(F.col(height))).alias("y")).select(image, F.explode(axis(F.col(width))).alias("x"), "y")


#: fixed values of the prior generators
PLATE_STEPS, PLATE_SIZES, PLATE_INPUT = (8, 16, 32), ((24.0, 48.0), (96.0, 192.0), (384.0, 768.0)), 640
QR_LAYERS = ((26, 16.0, 50.0, 100.0), (13, 32.0, 100.0, 150.0), (13, 32.0, 150.0, 200.0), (13, 32.0, 200.0, 300.0), (13, 32.0, 300.0, 400.0))
QR_RATIOS, QR_INPUT = (2.0, 0.5, 3.0, 1.0 / 3.0), 416
PALM_LAYERS, PALM_INPUT = ((24, 8.0), (12, 16.0), (12, 16.0), (12, 16.0)), 192


def priors(spark: SparkSession, layers: list[tuple[int, float, list[tuple[float, float]]]], size: float) -> DataFrame:
    """prior_idx, cx, cy, w, h (shares of the input) of grids (cells a side, step, sizes of each cell's priors), row by row."""
    parts, base = [], 0
    for cells, step, shapes in layers:
        n = len(shapes)
        cell = spark.range(cells * cells * n)
        at = F.floor(F.col("id") / n)
        shape = F.element_at(F.array(*[F.struct(F.lit(float(w)).alias("w"), F.lit(float(h)).alias("h")) for w, h in shapes]), (F.col("id") % n + 1).cast("int"))
        centre = lambda i: (i + 0.5) * step / size  # noqa: B023, E731
        parts.append(cell.select((F.col("id") + base).alias("prior_idx"), centre(at % cells).alias("cx"), centre(F.floor(at / cells)).alias("cy"), (shape["w"] / size).alias("w"), (shape["h"] / size).alias("h")))
        base += cells * cells * n
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def plate_priors(spark: SparkSession) -> DataFrame:
    """16 800 priors of the plate detector."""
    return priors(spark, [(-(-PLATE_INPUT // step), step, [(s, s) for s in sizes]) for step, sizes in zip(PLATE_STEPS, PLATE_SIZES)], PLATE_INPUT)


def qr_priors(spark: SparkSession) -> DataFrame:
    """8 112 priors of the QR detector: two squares and four ratios a cell."""
    layers = []
    for cells, step, low, high in QR_LAYERS:
        middle = math.sqrt(low * high)
        layers.append((cells, step, [(low, low), (middle, middle), *((low * math.sqrt(r), low / math.sqrt(r)) for r in QR_RATIOS)]))
    return priors(spark, layers, QR_INPUT)


def palm_anchors(spark: SparkSession, per_cell: int = 2) -> DataFrame:
    """2 016 anchors of the palm detector."""
    return priors(spark, [(cells, step, [(1.0, 1.0)] * per_cell) for cells, step in PALM_LAYERS], PALM_INPUT).select("prior_idx", "cx", "cy")
