"""Masks: decoding after suppression, alphas, areas and boxes, palettes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..plans.preprocess import PreprocessSpec, fit_of
from . import raster

MASK = "struct<width:int,height:int,data:array<float>>"


def prototype_mask(coefficients: np.ndarray, prototypes: np.ndarray, spec: PreprocessSpec, width: int, height: int, box: tuple[float, float, float, float]) -> np.ndarray:
    """A candidate's mask in the image: sigmoid of its mix of prototypes, without the letterbox, at the image's size, zero outside its box."""
    small = 1 / (1 + np.exp(-np.tensordot(coefficients[: len(prototypes)], prototypes, 1)))
    full = raster.resample(small, spec.width, spec.height)
    w, h, _, _, left, top = fit_of(spec, width, height)
    mask = raster.resample(full[max(top, 0) : max(top, 0) + h, max(left, 0) : max(left, 0) + w], width, height)
    x1, y1, x2, y2 = (int(v) for v in (np.floor(box[0]), np.floor(box[1]), np.ceil(box[2]), np.ceil(box[3])))
    out = np.zeros_like(mask)
    y1, x1 = max(y1, 0), max(x1, 0)
    out[y1 : max(y2, 0), x1 : max(x2, 0)] = mask[y1 : max(y2, 0), x1 : max(x2, 0)]
    return out.astype(np.float32)


def decode_masks(survivors: DataFrame, prototypes: DataFrame, spec: PreprocessSpec, image: str = "image_id", order: str = "anchor") -> DataFrame:
    """Adds mask to surviving candidates (coefficients, x1..y2, width and height of the image).

    prototypes: one row an image with shape [n, h, w] and data.  Only survivors are decoded, and an image's
    prototypes go to its survivors, not to all candidates.
    """
    joined = survivors.join(prototypes.select(image, F.col("shape").alias("_shape"), F.col("data").alias("_data")), image)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            masks = []
            for r in batch.rename(columns={"_shape": "shape", "_data": "data"}).itertuples():
                n, h, w = (int(v) for v in list(r.shape)[-3:])
                mask = prototype_mask(np.asarray(r.coefficients, np.float64), np.asarray(r.data, np.float64).reshape(n, h, w), spec, r.width, r.height, (r.x1, r.y1, r.x2, r.y2))
                masks.append({"width": r.width, "height": r.height, "data": mask.ravel().tolist()})
            yield pd.DataFrame({image: batch[image], order: batch[order], "mask": masks})

    kinds = dict(survivors.dtypes)
    wanted = joined.select(image, order, "coefficients", "width", "height", "x1", "y1", "x2", "y2", "_shape", "_data")
    return survivors.join(wanted.mapInPandas(decode, f"{image} {kinds[image]}, {order} {kinds[order]}, mask {MASK}"), [image, order])


def alpha(values: Column) -> Column:
    """Raw output to 0..1: through a sigmoid if it leaves that range by far, else clamped."""
    raw = (F.array_max(values) > 1.5) | (F.array_min(values) < -0.01)
    return F.transform(values, lambda v: F.when(raw, vectors.sigmoid(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), v.cast("double"))))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v.cast("double")))))


def two_channel_alpha(values: Column) -> Column:
    """Share of the second of two planes, by softmax."""
    half = (F.size(values) / 2).cast("int")
    return F.zip_with(F.slice(values, F.lit(1), half), F.slice(values, half + 1, half), lambda a, b: vectors.sigmoid(b.cast("double") - a.cast("double")))


def mean_alpha(mask: Column) -> Column:
    return vectors.total(mask["data"]) / F.size(mask["data"])


def area(mask: Column, threshold: float = 0.35) -> Column:
    return F.size(F.filter(mask["data"], lambda v: v > threshold))


def binary(mask: Column, threshold: float = 0.5) -> Column:
    """The mask's bytes, 255 above the threshold, as an array."""
    return F.transform(mask["data"], lambda v: F.when(v > threshold, 255).otherwise(0))


def box(mask: Column, threshold: float = 0.5) -> Column:
    """x1, y1, x2, y2 (the last pixels included) of what is above the threshold; null for nothing."""
    on = F.filter(F.transform(mask["data"], lambda v, i: F.when(v > threshold, i)), lambda i: i.isNotNull())
    xs, ys = F.transform(on, lambda i: i % mask["width"]), F.transform(on, lambda i: F.floor(i / mask["width"]).cast("int"))
    return F.when(F.size(on) > 0, F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")))


def union(a: Column, b: Column) -> Column:
    """Pixelwise maximum of two masks of one size; null if one is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a["width"].alias("width"), a["height"].alias("height"), F.zip_with(a["data"], b["data"], lambda x, y: F.greatest(x, y)).alias("data")))


def best_masks(masks: DataFrame, most: int = 30, least_area: int = 200, least_score: float = 0.5, image: str = "image_id") -> DataFrame:
    """Prompted masks worth keeping: large and sure enough, the `most` best of an image."""
    from pyspark.sql import Window

    good = masks.where((area(F.col("mask"), 0.5) > least_area) & (F.col("score") > least_score))
    return good.withColumn("_place", F.row_number().over(Window.partitionBy(image).orderBy(F.desc("score"), "prompt"))).where(F.col("_place") <= most).drop("_place")


def top_keypoints(features: DataFrame, most: int = 2048, threshold: float = 0.0, image: str = "image_id") -> DataFrame:
    """The `most` surest keypoints of an image that reach the threshold."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(image).orderBy(F.desc("score"), "kp_idx"))
    return features.withColumn("_place", place).where((F.col("_place") <= most) & (F.col("score") >= threshold)).drop("_place")


def region_mean(points: Column, start: int, stop: int) -> Column:
    """Mean x, y and score of keypoints start..stop-1; null if there are not as many."""
    part = F.slice(points, start + 1, stop - start)
    mean = lambda c: (vectors.total(F.transform(part, lambda p: p[c])) / (stop - start)).alias(c)
    return F.when(F.size(points) >= stop, F.struct(mean("x"), mean("y"), mean("score")))


def eye_centres(points: Column) -> Column:
    """left and right, from the 106 face points."""
    return F.struct(region_mean(points, 44, 56).alias("left"), region_mean(points, 74, 86).alias("right"))


def face_attributes(age: Column, gender: Column) -> Column:
    """Years (the output is in hundreds) and gender with its probability (female first)."""
    p = vectors.softmax(gender)
    return F.struct((age.cast("double") * 100).alias("age"), F.when(p[1] > p[0], "male").otherwise("female").alias("gender"), F.array_max(p).alias("probability"))


#: fixed values: order of the expression model's classes
EXPRESSIONS = ("neutral", "happiness", "surprise", "sadness", "anger", "disgust", "fear", "contempt")


def expression(logits: Column) -> Column:
    p = vectors.softmax(logits)
    return F.struct(F.element_at(F.array(*map(F.lit, EXPRESSIONS)), vectors.argmax(p) + 1).alias("label"), F.array_max(p).alias("score"))


def overlay(image: np.ndarray, classes: np.ndarray, share: float = 0.5) -> np.ndarray:
    """An image with its class plane (any size) in palette colours over it."""
    plane = classes[(np.arange(image.shape[0]) * classes.shape[0] // image.shape[0])[:, None], np.arange(image.shape[1]) * classes.shape[1] // image.shape[1]]
    return raster.byte(image[..., :3] * (1 - share) + palette(plane) * share)


def palette(plane: np.ndarray) -> np.ndarray:
    """B, G, R of each class by golden-angle hues at saturation 0.75 and value 0.95."""
    hue = plane.astype(np.float64) * 137.508 % 360 / 60
    channel = lambda k: 0.95 * (1 - 0.75 * np.clip(np.minimum((k + hue) % 6, 4 - (k + hue) % 6), 0, 1))
    return raster.byte(np.stack([channel(1), channel(3), channel(5)], axis=-1) * 255)
