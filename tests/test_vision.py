"""Assembled engines with models of a few lines of NumPy, several-input scoring, regions, match counts."""

import numpy as np
import pytest

from pixelyard.errors import InvalidArgument
from pixelyard.functions.arrays import keep_boxes, unfit
from pixelyard.operators import decode, raster, search
from pixelyard.plans import scoring, vision
from pixelyard.plans.preprocess import PRESETS


def image_rows(spark, sizes=((64, 48), (40, 80)), broken=True):
    rng = np.random.default_rng(1)
    rows = [(i, w, h, 3, bytearray(rng.integers(0, 256, (h, w, 3), dtype=np.uint8).tobytes())) for i, (w, h) in enumerate(sizes)]
    rows += [(99, 4, 4, 3, bytearray(b"short"))] if broken else []
    return spark.createDataFrame(rows, "image_id long, width int, height int, channels int, data binary")


def fixed(*outputs):
    """A model with the same outputs for every image."""
    return lambda: lambda batch: [(f"o{k}", np.stack([np.asarray(x, np.float32)] * len(batch))) for k, x in enumerate(outputs)]


def rows_of(df):
    rows = df.collect()
    assert [r["image_id"] for r in rows if r["error"]] == [99]
    return [r for r in rows if not r["error"]]


def test_segment(spark):
    # two anchors on one thing, one of another class; the prototypes are on the left and on the right
    anchors = np.array([[32, 32, 32, 32, 0.9, 0.1, 9, -9], [33, 32, 32, 32, 0.8, 0.1, 9, -9], [32, 32, 40, 40, 0.0, 0.7, -9, 9], [5, 5, 2, 2, 0.1, 0.2, 0, 0]]).T
    half = np.zeros((2, 16, 16))
    half[0, :, :8] = half[1, :, 8:] = 1
    got = rows_of(vision.segment(image_rows(spark), fixed(anchors, half), classes=2, coefficients=2, width=64, height=64))
    assert sorted((r["image_id"], r["class_id"]) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    spec = vision.spec_for("letterbox", width=64, height=64)
    for r in got:
        mask = np.array(r["mask"]["data"]).reshape(r["mask"]["height"], r["mask"]["width"])
        box = unfit(np.array([[16, 16, 48, 48] if r["class_id"] == 0 else [12, 12, 52, 52]]), spec, mask.shape[1], mask.shape[0])[0]
        assert np.allclose([r["x1"], r["y1"], r["x2"], r["y2"]], np.clip(box, 0, [mask.shape[1], mask.shape[0]] * 2))
        ys, xs = np.nonzero(mask > 0.9)
        middle = mask.shape[1] / 2
        assert len(xs) and (xs.max() < middle + 3 if r["class_id"] == 0 else xs.min() > middle - 3)


def test_poses_and_rotated(spark):
    anchors = np.array([[32, 32, 20, 20, 0.9, 30, 31, 0.5, 34, 35, 4.0], [32, 32, 20, 20, 0.2, 0, 0, 0, 0, 0, 0]]).T
    got = rows_of(vision.poses(image_rows(spark, ((64, 64),)), fixed(anchors), points=2, width=64, height=64))
    assert [(p["x"], p["y"], round(p["score"], 3)) for p in got[0]["points"]] == [(30, 31, 0.5), (34, 35, 0.982)] and len(got) == 1
    boxes = np.array([[20, 20, 10, 4, 0.9, 0.0], [20, 20, 10, 4, 0.8, 0.05], [20, 20, 10, 4, 0.7, 1.5], [40, 40, 6, 6, 0.4, 0.0]]).T
    got = rows_of(vision.rotated(image_rows(spark, ((128, 128),)), fixed(boxes), classes=1, width=64, height=64))
    assert [(round(r["score"], 2), r["cx"], r["w"], round(r["angle"], 2)) for r in got] == [(0.9, 40, 20, 0.0), (0.7, 40, 20, 1.5)]


def test_faces_by_both_layouts(spark):
    images = image_rows(spark, ((64, 64),))
    fused = np.zeros((3, 15))
    fused[:, :4], fused[:, 14] = [[8, 8, 16, 16], [9, 8, 16, 16], [40, 40, 8, 8]], [0.9, 0.95, 0.5]
    fused[:, 4:14] = 12
    got = rows_of(vision.faces(images, fixed(fused), width=64, height=64))
    assert [(round(r["score"], 2), r["x1"], r["x2"], r["points"][4]["y"]) for r in got] == [(0.95, 9, 25, 12)]
    heads = []
    for kind in (1, 1, 4, 10):
        for stride in (8, 16, 32):
            head = np.zeros(((64 // stride) ** 2, kind))
            if stride == 16 and kind == 1:
                head[5] = 0.81
            heads.append(head)
    got = rows_of(vision.faces(images, fixed(*heads), width=64, height=64))
    # cell 5 of 4 x 4 is column 1, row 1
    assert [(round(r["score"], 2), r["x1"], r["y2"], r["points"][0]["x"]) for r in got] == [(0.81, 8, 24, 16)]


def test_planes(spark):
    images = image_rows(spark, ((8, 4),))
    ramp = np.arange(32.0).reshape(1, 4, 8)
    got = rows_of(vision.depth(images, fixed(ramp), width=8, height=4))
    assert np.allclose(got[0]["values"], np.arange(32) / 31)
    got = rows_of(vision.alphas(images, fixed(np.stack([ramp[0] * 0, ramp[0] * 0 + np.log(3)])), width=8, height=4))
    assert np.allclose(got[0]["values"], 0.75)
    two = np.stack([ramp[0] < 16, ramp[0] >= 16]).astype(float)
    got = rows_of(vision.classes_by_pixel(images, fixed(two), classes=2, width=8, height=4))
    assert got[0]["values"] == [0] * 16 + [1] * 16 and got[0]["shares"] == [0.5, 0.5]


def test_keypoints_and_embeddings(spark):
    x, y = np.zeros((2, 16)), np.zeros((2, 16))
    x[0, 4], x[1, 6], y[0, 8], y[1, 2] = 0.9, 0.8, 0.7, 1.0
    got = rows_of(vision.keypoints(image_rows(spark, ((16, 16),)), fixed(x, y), points=2, width=8, height=8))
    assert [(p["x"], p["y"], round(p["score"], 2)) for p in got[0]["points"]] == [(4, 8, 0.7), (6, 2, 0.8)]
    got = rows_of(vision.embeddings(image_rows(spark, ((16, 16),)), fixed(np.array([3.0, 4.0]))))
    assert np.allclose(got[0]["embedding"], [0.6, 0.8])


def test_read_text(spark):
    images = image_rows(spark, ((64, 64),), broken=False)
    plane = np.zeros((1, 64, 64))
    plane[0, 40:50, 30:60] = plane[0, 10:20, 5:25] = 0.9
    plane[0, 10:20, 30:50] = 0.4  # too faint
    plane[0, 60:62, 0:30] = 0.9  # too narrow
    steps = np.eye(4)[[1, 1, 0, 1, 2, 3]]
    got = vision.read_text(images, fixed(plane), fixed(steps), ["a", "b"]).orderBy("box_no").collect()
    assert [(r["box_no"], r["x1"], r["y1"], r["text"], r["score"]) for r in got] == [(0, 5, 10, "aab", 1.0), (1, 30, 40, "aab", 1.0)]


def test_enhance_by_model(spark):
    images = image_rows(spark, ((30, 20),))
    twice = lambda: lambda batch: [("o", batch.repeat(2, axis=2).repeat(2, axis=3))]
    got = rows_of(vision.create("super_resolution", twice, size=8, pad=2, scale=2)(images))
    before = np.frombuffer(images.where("image_id = 0").first()["data"], np.uint8).reshape(20, 30, 3)
    assert np.array_equal(np.frombuffer(got[0]["data"], np.uint8).reshape(40, 60, 3), before.repeat(2, axis=0).repeat(2, axis=1))
    with pytest.raises(InvalidArgument):
        vision.create("nothing", twice)


def test_several_inputs(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], [2]), (2, [1.0, 1.0], [5]), (3, None, [1]), (4, [1.0], [1])], "image_id long, points array<float>, label array<long>")
    model = lambda: lambda given: [("sum", given["points"].sum(axis=1) * given["label"])]
    got = scoring.score_named(rows, model, {"points": ("points", (-1, 2)), "label": ("label", (1,))}).orderBy("image_id").collect()
    assert [r["f32"] for r in got] == [[8.0, 12.0], [5.0, 5.0], None, None] and [r["error"] is None for r in got] == [True, True, False, False]


def test_regions():
    rng = np.random.default_rng(3)
    for _ in range(30):
        plane = rng.random((rng.integers(1, 12), rng.integers(1, 12))) < 0.4
        want, seen = [], set()
        for y, x in zip(*np.nonzero(plane)):
            if (y, x) in seen:
                continue
            part, work = set(), [(y, x)]
            while work:
                a, b = work.pop()
                if (a, b) in part or not (0 <= a < plane.shape[0] and 0 <= b < plane.shape[1]) or not plane[a, b]:
                    continue
                part.add((a, b))
                work += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            seen |= part
            want.append(part)
        assert [set(zip(y.tolist(), x.tolist())) for y, x in raster.regions(plane)] == [{(int(a), int(b)) for a, b in p} for p in want]


def test_keep_boxes_and_letterbox():
    boxes = np.array([[0, 0, 10, 10], [0, 0, 10, 9], [0, 0, 10, 10], [20, 20, 20, 20]], float)
    assert keep_boxes(boxes, np.array([0.5, 0.9, 0.9, 0.1]), 0.5).tolist() == [1, 3]
    assert keep_boxes(boxes, np.array([0.5, 0.9, 0.9, 0.1]), 0.5, np.array([0, 1, 0, 0])).tolist() == [1, 2, 3]
    assert np.allclose(unfit(np.array([[0.0, 80.0, 640.0, 560.0]]), PRESETS["letterbox_plain"], 1280, 960), [[0, 0, 1280, 960]])


def test_top_queries_and_match_counts(spark):
    queries = spark.createDataFrame([(1, 0, 0, 0.5), (1, 0, 1, 0.5), (1, 1, 2, 0.05), (2, 0, 0, 0.2), (2, 0, 1, 0.3)], "image_id long, class_id int, query int, score double")
    assert sorted((r["image_id"], r["query"]) for r in decode.top_queries(queries).collect()) == [(1, 0), (2, 1)]
    scores = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.9), (1, 1, 0, 0.5), (1, 1, 1, 0.9), (1, 2, 2, 0.05)], "pair_id long, a int, b int, score double")
    mutual = search.mutual_matches(scores)
    assert sorted((r["a"], r["b"]) for r in mutual.collect()) == [(0, 0)]
    assert [tuple(r) for r in search.match_counts(scores, 0.9).collect()] == [(1, 5, 3)]
