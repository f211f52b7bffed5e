"""Masks, alphas, attributes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelyard.functions.text import palette_colour
from pixelyard.operators import masks
from pixelyard.plans.preprocess import PreprocessSpec


def test_decode_masks(spark):
    spec = PreprocessSpec(width=16, height=16, fit="letterbox", pad_value=114.0)
    data = [float(v) for v in np.concatenate([np.full(16, 9.0), np.linspace(-9, 9, 16)])]
    prototypes = spark.createDataFrame([(1, [1, 2, 4, 4], data)], "image_id long, shape array<long>, data array<float>")
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0], 32, 16, 4.0, 2.0, 12.0, 10.0)], "image_id long, anchor int, coefficients array<float>, width int, height int, x1 double, y1 double, x2 double, y2 double")
    r = masks.decode_masks(rows, prototypes, spec).select("mask", masks.area(F.col("mask")).alias("n"), masks.box(F.col("mask")).alias("b")).first()
    assert (r["mask"]["width"], r["mask"]["height"], r["n"], tuple(r["b"])) == (32, 16, 64, (4, 2, 11, 9))
    assert max(r["mask"]["data"]) > 0.99


def test_columns(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    m = lambda *x: F.struct(F.lit(2).alias("width"), F.lit(2).alias("height"), a(*x).alias("data"))
    r = spark.range(1).select(
        masks.alpha(a(-3, 3)).alias("s"), masks.alpha(a(0.2, 1.2)).alias("c"), masks.two_channel_alpha(a(0, 1, 0, 1)).alias("t"), masks.mean_alpha(m(0, 1, 1, 0)).alias("m"),
        masks.union(m(0, 1, 0, 0), m(1, 0, 0, 0)).alias("u"), masks.box(m(0, 0, 0, 0)).alias("n"), masks.binary(m(0, 0.6, 0, 1)).alias("b"),
        masks.face_attributes(F.lit(0.31), a(0, 2)).alias("f"), masks.expression(a(0, 5, 0, 0, 0, 0, 0, 0)).alias("e"),
    ).first()
    assert r["s"] == pytest.approx([0.047426, 0.952574], abs=1e-5) and r["c"] == [0.2, 1.0] and r["t"] == [0.5, 0.5] and r["m"] == 0.5
    assert r["u"]["data"] == [1, 1, 0, 0] and r["n"] is None and r["b"] == [0, 255, 0, 255]
    assert r["f"]["age"] == pytest.approx(31) and r["f"]["gender"] == "male" and r["e"]["label"] == "happiness"
    points = F.transform(F.sequence(F.lit(0), F.lit(105)), lambda i: F.struct(i.alias("x"), (i * 2).alias("y"), F.lit(1.0).alias("score")))
    eyes = spark.range(1).select(masks.eye_centres(points).alias("e")).first()["e"]
    assert eyes["left"]["x"] == 49.5 and eyes["right"]["y"] == 159


def test_ranks(spark):
    rows = spark.createDataFrame([(1, k, 0.1 * k) for k in range(10)], "image_id long, kp_idx int, score double")
    assert sorted(r["kp_idx"] for r in masks.top_keypoints(rows, 3, 0.75).collect()) == [8, 9]
    mask = F.struct(F.lit(20).alias("width"), F.lit(20).alias("height"), F.array_repeat(F.lit(1.0), 400).alias("data"))
    many = rows.select("image_id", F.col("kp_idx").alias("prompt"), "score", mask.alias("mask"))
    assert sorted(r["prompt"] for r in masks.best_masks(many, 2).collect()) == [8, 9]


def test_palette(spark):
    plane = np.arange(12).reshape(3, 4)
    want = spark.range(12).select(palette_colour(F.col("id")).alias("c")).orderBy("id").collect()
    assert [tuple(c) for c in masks.palette(plane).reshape(-1, 3).tolist()] == [tuple(r["c"]) for r in want]
    assert masks.overlay(np.zeros((6, 8, 3), np.uint8), plane).shape == (6, 8, 3)


def test_pipelines_of_masks(spark):
    from pixelyard.plans import pipelines

    mask = F.struct(F.lit(2).alias("width"), F.lit(2).alias("height"), F.array(*[F.lit(v) for v in (0.0, 0.9, 0.0, 0.9)]).alias("data"))
    boxes = spark.createDataFrame([(1, 1, "cat", 0.0, 0.0, 9.0, 9.0), (1, 2, "dog", 0.0, 0.0, 9.0, 9.0)], "image_id long, det_id long, phrase string, x1 double, y1 double, x2 double, y2 double")
    found = spark.createDataFrame([(1, 1, 0, 0.4), (1, 1, 1, 0.8)], "image_id long, det_id long, mask_no int, mask_score double").withColumn("mask", mask)
    joined = pipelines.grounded_segmentation(boxes, found)
    assert sorted((r["phrase"], r["mask_score"]) for r in joined.collect()) == [("cat", 0.8), ("dog", None)]
    assert [(r["x1"], r["y1"], r["x2"], r["y2"]) for r in pipelines.boxes_of_masks(joined).collect()] == [(1.0, 0.0, 1.0, 1.0)]
    cells = spark.createDataFrame([(1, 0, 0.0, 0.0, 5.0, 5.0), (1, 1, 5.0, 0.0, 9.0, 5.0)], "table_id int, cell_no int, x1 double, y1 double, x2 double, y2 double")
    words = spark.createDataFrame([(1, 3.0, 1.0, "b"), (1, 1.0, 1.0, "a")], "table_id int, x double, y double, text string")
    assert sorted((r["cell_no"], r["text"]) for r in pipelines.text_in_cells(cells, words).collect()) == [(0, "a b"), (1, None)]
