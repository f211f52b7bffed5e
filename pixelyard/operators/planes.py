"""Pixel planes as long tables (image, y, x, v): thresholds, morphology, statistics, class maps, quality."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .suppression import in_groups


def threshold(v: Column, limit: float, most: int = 255, inverse: bool = False) -> Column:
    return F.when(v > limit, 0 if inverse else most).otherwise(most if inverse else 0)


def saturate(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.round(v))).cast("int")


def scale_and_shift(v: Column, alpha: float, beta: float) -> Column:
    return saturate(v * alpha + beta)


def gray(b: Column, g: Column, r: Column) -> Column:
    return F.round(r * 0.299 + g * 0.587 + b * 0.114).cast("int")


def bounding_rect(planes: DataFrame, image: str = "image_id", least: float = 0.0) -> DataFrame:
    """x, y, width, height of the pixels above `least`; zeros where there is none."""
    on = F.col("v") > least
    edge = lambda f, c: f(F.when(on, F.col(c)))
    hull = planes.groupBy(image).agg(edge(F.min, "x").alias("x0"), edge(F.max, "x").alias("x1"), edge(F.min, "y").alias("y0"), edge(F.max, "y").alias("y1"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    return hull.select(image, zero(F.col("x0")).alias("x"), zero(F.col("y0")).alias("y"), zero(F.col("x1") - F.col("x0") + 1).alias("width"), zero(F.col("y1") - F.col("y0") + 1).alias("height"))


def min_max_loc(planes: DataFrame, image: str = "image_id") -> DataFrame:
    """Smallest and largest value with the first place (row by row) of each."""
    low, high = F.min(F.struct("v", "y", "x")), F.max(F.struct(F.col("v"), (-F.col("y")).alias("y"), (-F.col("x")).alias("x")))
    return planes.groupBy(image).agg(low.alias("l"), high.alias("h")).select(image, F.col("l.v").alias("min_v"), F.col("l.x").alias("min_x"), F.col("l.y").alias("min_y"), F.col("h.v").alias("max_v"), (-F.col("h.x")).alias("max_x"), (-F.col("h.y")).alias("max_y"))


def morphology(planes: DataFrame, kind: str, kernel: int = 3, image: str = "image_id") -> DataFrame:
    """erode, dilate, open or close with a square kernel, row pass then column pass; beyond the border is 0."""
    if kind in ("open", "close"):
        first, second = ("erode", "dilate") if kind == "open" else ("dilate", "erode")
        return morphology(morphology(planes, first, kernel, image), second, kernel, image)
    reach = kernel // 2
    out = planes.select(image, "y", "x", "v")
    for line, along in (("y", "x"), ("x", "y")):
        window = Window.partitionBy(image, line).orderBy(along).rowsBetween(-reach, kernel - 1 - reach)
        whole = F.count("v").over(window) == kernel
        value = F.min("v").over(window) if kind == "erode" else F.max("v").over(window)
        out = out.withColumn("v", F.when(whole, value).otherwise(F.least(value, F.lit(0)) if kind == "erode" else F.greatest(value, F.lit(0))))
    return out


def class_histogram(planes: DataFrame, image: str = "image_id") -> DataFrame:
    """Pixels of each class, with their rank by number."""
    counted = planes.groupBy(image, F.col("v").alias("class_id")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(image).orderBy(F.desc("n"), "class_id")))


def part_ratios(planes: DataFrame, image: str = "image_id") -> DataFrame:
    """Share of each class but 0 in all of an image's pixels."""
    counted = planes.groupBy(image, F.col("v").alias("class_id")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("ratio", F.col("n") / F.sum("n").over(Window.partitionBy(image))).where("class_id <> 0").drop("n")


def min_max_normalize(planes: DataFrame, image: str = "image_id", epsilon: float = 1e-6) -> DataFrame:
    """v from 0 to 1 within an image; zeros where all are the same."""
    w = Window.partitionBy(image)
    low, span = F.min("v").over(w), F.max("v").over(w) - F.min("v").over(w)
    return planes.withColumn("v", F.when(span > epsilon, (F.col("v") - low) / F.when(span > epsilon, span)).otherwise(0.0))


def mask_union(a: Column, b: Column) -> Column:
    """The larger of both values of each pixel; null if a mask is missing."""
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def mask_area(data: Column, limit: float = 0.35) -> Column:
    return F.size(F.filter(data, lambda v: v > limit))


def neighbours(data: Column, width: Column, height: Column, fold) -> Column:
    """fold(p) of each inner pixel of a plane held as an array, where p(dx, dy) is a neighbour."""
    inner = F.transform(
        F.sequence(F.lit(0), (width - 2) * (height - 2) - 1),
        lambda i: fold(lambda dx, dy: F.element_at(data, ((F.floor(i / (width - 2)) + 1 + dy) * width + i % (width - 2) + 1 + dx + 1).cast("int")).cast("double")),
    )
    return F.when((width >= 3) & (height >= 3), inner)


def image_quality(planes: DataFrame, data: str = "data", width: str = "width", height: str = "height", weights: tuple[float, float, float, float] = (0.4, 0.2, 0.25, 0.15), scales: tuple[float, float, float] = (500.0, 50.0, 15.0)) -> DataFrame:
    """Adds blur (variance of the Laplacian), brightness, contrast, noise and overall of a gray plane held as an array.

    Stays within the row, so there is no shuffle; planes below 3 x 3 have nulls.
    """
    w, h = F.col(width), F.col(height)
    sum_of = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    laplace = neighbours(F.col(data), w, h, lambda p: p(0, -1) + p(0, 1) + p(-1, 0) + p(1, 0) - 4 * p(0, 0))
    mask = neighbours(F.col(data), w, h, lambda p: F.abs(p(-1, -1) - 2 * p(0, -1) + p(1, -1) - 2 * p(-1, 0) + 4 * p(0, 0) - 2 * p(1, 0) + p(-1, 1) - 2 * p(0, 1) + p(1, 1)))
    out = planes.withColumn("_l", laplace).withColumn("_v", F.transform(data, lambda v: v.cast("double")))
    mean_l = sum_of(F.col("_l")) / F.size("_l")
    blur = F.greatest(sum_of(F.transform("_l", lambda v: v * v)) / F.size("_l") - mean_l * mean_l, F.lit(0.0))
    out = out.withColumn("blur", blur).withColumn("brightness", sum_of(F.col("_v")) / F.size("_v"))
    out = out.withColumn("contrast", F.sqrt(sum_of(F.transform("_v", lambda v: (v - F.col("brightness")) * (v - F.col("brightness")))) / F.size("_v")))
    out = out.withColumn("noise", F.lit(math.sqrt(math.pi / 2)) * sum_of(mask) / (6 * (w - 2) * (h - 2)))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    parts = (F.col("blur") / (F.col("blur") + scales[0]), 1 - F.abs(F.col("brightness") - 127.5) / 127.5, unit(F.col("contrast") / scales[1]), unit(1 - F.col("noise") / scales[2]))
    return out.withColumn("overall", unit(sum((p * x for p, x in zip(parts, weights)), F.lit(0.0)) / sum(weights))).drop("_l", "_v")


def components(planes: DataFrame, limit: float = 0.3, image: str = "image_id", value: str = "v") -> DataFrame:
    """8-connected regions of pixels above the limit: image, component (in order of discovery), area, box, mean value, second-moment angle.

    One exchange by image; then the pixels of many images are labelled at once, in NumPy.  An image's pixels fit a task.
    Null values and NaN are below any limit.  A plane has a pixel once.
    """
    names = ["component", "area", "x1", "y1", "x2", "y2", "mean", "angle"]

    def label(table: pa.Table, begin: np.ndarray) -> pa.Table:
        part = np.repeat(np.arange(len(begin)), np.diff([*begin, table.num_rows]))
        y, x, v = table["y"].to_numpy().astype(np.int64), table["x"].to_numpy().astype(np.int64), table[value].to_numpy()
        wide, high = int(x.max() - x.min()) + 3, int(y.max() - y.min()) + 3  # a blank line between neighbouring rows and planes
        at = (part * high + y - y.min()) * wide + x - x.min()
        order = np.argsort(at, kind="stable")
        at, part, y, x, v = at[order], part[order], y[order], x[order], v[order]
        home = np.arange(len(at))
        one, two = [], []
        for step in (1, wide - 1, wide, wide + 1):
            spot = np.minimum(np.searchsorted(at, at + step), len(at) - 1)
            near = np.flatnonzero(at[spot] == at + step)
            one.append(near)
            two.append(spot[near])
        one, two = np.concatenate(one), np.concatenate(two)
        while True:  # regions that touch take the smaller home, and homes are followed to their ends
            a, b = home[one], home[two]
            apart = a != b
            if not apart.any():
                break
            one, two, a, b = one[apart], two[apart], a[apart], b[apart]
            np.minimum.at(home, np.maximum(a, b), np.minimum(a, b))
            while (home[home] != home).any():
                home = home[home]
        first, region = np.unique(home, return_inverse=True)
        n = np.bincount(region)
        add = lambda w: np.bincount(region, w, len(first))
        ends = lambda f, w, start: (out := np.full(len(first), start), f.at(out, region, w))[0].astype(np.int32)
        far = np.iinfo(np.int64).max
        sx, sy = add(x), add(y)
        angle = 0.5 * np.arctan2(2 * (n * add(x * y) - sx * sy), (n * add(x * x) - sx * sx) - (n * add(y * y) - sy * sy))
        starts = np.flatnonzero(np.concatenate([[True], part[first][1:] != part[first][:-1]]))
        number = np.arange(len(first)) - np.repeat(starts, np.diff([*starts, len(first)]))
        own = table[image].take(pa.array(order[first]))
        return pa.table(
            [own, *(pa.array(c.astype(np.int32)) for c in (number, n)), *(pa.array(c) for c in (ends(np.minimum, x, far), ends(np.minimum, y, far), ends(np.maximum, x, -far), ends(np.maximum, y, -far))), pa.array(add(v) / n), pa.array(angle)],
            [image, *names],
        )

    rows = planes.where((F.col(value) > limit) & ~F.isnan(F.col(value).cast("double"))).select(image, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(value).cast("double").alias(value))
    return in_groups(rows, [image], label, f"{image} {dict(planes.dtypes)[image]}, component int, area int, x1 int, y1 int, x2 int, y2 int, mean double, angle double")
