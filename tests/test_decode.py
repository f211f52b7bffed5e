"""Decoders of raw outputs on small tensors."""

import math

import pytest
from pyspark.sql import functions as F

from pixelyard.functions import geometry
from pixelyard.operators import decode, sequences, suppression


def outputs(spark, values):
    return spark.createDataFrame([(1, [float(v) for v in values])], "image_id long, f32 array<float>")


def test_layouts(spark):
    major = decode.anchors(outputs(spark, [1, 2, 3, 10, 20, 30]), "f32", 2)
    minor = decode.anchors(outputs(spark, [1, 10, 2, 20, 3, 30]), "f32", 2, channel_major=False)
    for rows in (major, minor):
        assert [(r["anchor"], r["v"]) for r in rows.orderBy("anchor").collect()] == [(0, [1, 10]), (1, [2, 20]), (2, [3, 30])]
    assert decode.anchors(outputs(spark, []), "f32", 2).isEmpty()


def test_end_to_end_and_thresholds(spark):
    rows = decode.anchors(outputs(spark, [0, 0, 4, 4, 0.5, 2, 1, 1, 3, 3, 0.49, 1]), "f32", 6, channel_major=False)
    got = decode.decode_end_to_end(rows).collect()
    assert [(r["class_id"], r["x2"], r["score"]) for r in got] == [(2, 4.0, 0.5)]
    strict = decode.decode_end_to_end(rows, "transformer").collect()
    assert strict == []  # 0.5 isn't above 0.5


def test_transformer_queries(spark):
    # logits beyond 0..1 get a sigmoid; boxes are shares of a 100 x 50 image
    rows = decode.anchors(outputs(spark, [0.5, 0.5, 0.2, 0.4, 3, -2, 0.9, 0.9, 0.4, 0.4, -1, 0.1]), "f32", 6, channel_major=False)
    got = decode.decode_queries(rows, F.lit(100), F.lit(50)).orderBy("anchor").collect()
    assert [(r["anchor"], r["class_id"]) for r in got] == [(0, 0), (1, 1)]
    assert got[0]["score"] == pytest.approx(1 / (1 + math.exp(-3))) and (got[0]["x1"], got[0]["y1"], got[0]["x2"], got[0]["y2"]) == pytest.approx((40, 15, 60, 35), rel=1e-6)
    assert got[1]["x2"] == 100 and got[1]["y2"] == 50
    assert decode.decode_queries(rows, F.lit(100), F.lit(50), most=1).count() == 1


def test_rotated(spark):
    rows = decode.anchors(outputs(spark, [5, 5, 4, 2, 0.1, 0.9, 0.7]), "f32", 7, channel_major=False)
    r = decode.decode_rotated(rows, 2).first()
    assert (r["class_id"], r["w"], round(r["angle"], 5)) == (1, 4.0, 0.7)
    e = decode.decode_rotated_end_to_end(decode.anchors(outputs(spark, [5, 5, 4, 2, 0.6, 3, 1.5]), "f32", 7, channel_major=False)).first()
    assert (e["class_id"], e["angle"]) == (3, 1.5)
    box = spark.range(1).select(geometry.upright_hull(geometry.corners(F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(2.0), F.lit(math.pi / 2))).alias("b")).first()["b"]
    assert tuple(box) == pytest.approx((-1, -2, 1, 2))
    assert suppression.rotated_corners(0, 0, 4, 2, math.pi / 2)[0] == pytest.approx((1, -2))


def test_keypoints_and_face(spark):
    v = F.array(*[F.lit(float(x)) for x in (9, 9, 1, 2, 0.5, 3, 4, 2.0)])
    k = spark.range(1).select(decode.keypoints_from(v, 2, 2).alias("k"), decode.decode_face_score(F.lit(0.64), F.lit(1.5)).alias("s")).first()
    assert [(p["x"], p["y"]) for p in k["k"]] == [(1, 2), (3, 4)] and k["k"][0]["score"] == 0.5
    assert k["k"][1]["score"] == pytest.approx(1 / (1 + math.exp(-2)), abs=1e-6) and k["s"] == pytest.approx(0.8)


def test_phrases(spark):
    tokens = ["[CLS]", "red", "cat", ".", "dog", ".", "[SEP]", "[PAD]"]
    rows = [(1, 0, [-9.0, 1.0, 3.0, -9.0, 0.0, -9.0, -9.0, 9.0], tokens), (1, 1, [-9.0] * 4 + [-0.5] + [-9.0] * 3, tokens), (1, 2, [-9.0] * 8, tokens), (1, 3, [-9.0, -9.0, -9.0, 5.0, -9.0, -9.0, -9.0, -9.0], tokens)]
    df = spark.createDataFrame(rows, "image_id long, query int, logits array<double>, tokens array<string>")
    assert sorted((r["query"], r["phrase"]) for r in decode.token_phrases(df).collect()) == [(0, "red cat"), (1, "dog")]


def test_cells(spark):
    points = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    r = spark.range(1).select(sequences.cell_boxes(points(0.1, 0.2, 0.3, 0.2, 0.3, 0.4, 0.1, 0.4), F.lit(100), F.lit(50)).alias("a"), sequences.cell_boxes(points(*[0] * 8), F.lit(100), F.lit(50)).alias("b")).first()
    assert tuple(r["a"]) == pytest.approx((10, 20, 30, 40)) and r["b"] is None


def test_labels(spark):
    rows = spark.createDataFrame([(0,), (7,)], "class_id int")
    names = spark.createDataFrame([(0, "cat")], "class_id int, name string")
    assert sorted((r["class_id"], r["class_name"]) for r in decode.with_labels(rows, names).collect()) == [(0, "cat"), (7, "7")]
    top = decode.from_scores(spark.createDataFrame([(1, [0.2, 0.7, 0.7]), (2, [0.1, 0.2, 0.3])], "image_id long, scores array<double>"), 2, 0.5)
    assert [(r["image_id"], r["rank"], r["class_id"]) for r in top.orderBy("rank").collect()] == [(1, 1, 1), (1, 2, 2)]
