"""Operators against known values and plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelyard.errors import InvalidArgument, ModelNotFound, Unsupported
from pixelyard.functions import geometry, rules, text, vectors
from pixelyard.operators import decode, planes, raster, search, sequences, slicing, suppression
from pixelyard.plans import engines, pipelines, scoring
from pixelyard.plans.preprocess import PRESETS, PreprocessSpec, preprocess
from pixelyard.sources import tables
from pixelyard.streaming import batches


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_rotated_iou():
    iou = suppression.rotated_iou
    assert iou((0, 0, 10, 10, 0.3), (0, 0, 10, 10, 0.3)) == pytest.approx(1)
    assert iou((0, 0, 10, 10, 0), (5, 0, 10, 10, 0)) == pytest.approx(1 / 3)
    assert iou((0, 0, 10, 10, 0), (0, 0, 10, 10, math.pi / 4)) == pytest.approx(math.sqrt(2) / 2, abs=1e-3)
    assert iou((0, 0, 9, 29, 0.7), (8 * math.cos(0.7), 8 * math.sin(0.7), 9, 29, 0.7)) == pytest.approx(29 / 493)
    assert iou((0, 0, 10, 10, 0), (50, 50, 10, 10, 1)) == 0
    rng = random.Random(1)
    for _ in range(300):
        a, b = (tuple(rng.uniform(0, 20) for _ in range(2)) + tuple(rng.uniform(1, 15) for _ in range(2)) + (rng.uniform(0, 3),) for _ in range(2))
        assert suppression.may_overlap(a, b, 0.3) or iou(a, b) <= 0.3


def random_boxes(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.randint(0, 60), rng.randint(0, 60)
        rows.append((1, i, rng.randint(0, 1), float(x), float(y), float(x + rng.randint(5, 40)), float(y + rng.randint(5, 40)), rng.choice([0.5, 0.6, 0.7, rng.random()])))
    return rows


def loop_merge(rows, threshold, transitive):
    def share(a, b):
        inter = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
        return inter / min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))

    out = []
    for cls in (0, 1):
        rs = sorted((r for r in rows if r[2] == cls), key=lambda r: (-r[7], *r[3:7], r[1]))
        keeper, groups = {}, {}
        for i, r in enumerate(rs):
            if i not in keeper:
                keeper[i] = i
                groups[i] = []
            elif not transitive:
                continue
            for j in range(i + 1, len(rs)):
                if j not in keeper and share(r[3:7], rs[j][3:7]) >= threshold:
                    keeper[j] = keeper[i]
                    groups[keeper[i]].append(j)
        for k, ms in groups.items():
            box, n = list(rs[k][3:7]), 1
            for m in ms:
                b = rs[m][3:7]
                if share(box, b) > threshold:
                    box, n = [min(box[0], b[0]), min(box[1], b[1]), max(box[2], b[2]), max(box[3], b[3])], n + 1
            out.append((rs[k][1], cls, *box, rs[k][7], n))
    return sorted(out)


@pytest.mark.parametrize("transitive", [False, True])
def test_merging(spark, transitive):
    for seed in (1, 2):
        rows = random_boxes(seed)
        df = spark.createDataFrame(rows, "image_id long, seq long, class_id int, x1 double, y1 double, x2 double, y2 double, score double")
        got = (suppression.transitive_merge if transitive else suppression.greedy_merge)(df)
        assert sorted(tuple(r) for r in got.select("seq", "class_id", "x1", "y1", "x2", "y2", "score", "members").collect()) == loop_merge(rows, 0.5, transitive)


def test_rotated_suppression(spark):
    rows = [(1, 0, 0.0, 0.0, 10.0, 10.0, 0.0, 0.9), (1, 1, 1.0, 0.0, 10.0, 10.0, 0.0, 0.8), (1, 2, 30.0, 0.0, 10.0, 10.0, 0.0, 0.7), (2, 3, 0.0, 0.0, 10.0, 10.0, 0.0, 0.1)]
    df = spark.createDataFrame(rows, "image_id long, seq long, cx double, cy double, w double, h double, angle double, score double")
    assert sorted(r["seq"] for r in suppression.rotated_suppression(df).collect()) == [0, 2, 3]


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    r = one(spark, vectors.cosine(v(1, 2), v(2, 4)), vectors.cosine(v(1, 0), v(0, 1)), vectors.cosine(v(1, 1), v(-1, -1)), vectors.cosine(v(0, 0), v(1, 1)))
    assert tuple(r) == pytest.approx((1, 0, -1, 0))
    with pytest.raises(Exception, match="different lengths"):
        one(spark, vectors.dot(v(1), v(1, 2)))
    r = one(spark, vectors.argmax(v(1, 3, 3)).alias("a"), vectors.argmax_last(v(1, 3, 3)).alias("b"), vectors.argmax_positive(v(-1, 0)).alias("c"), vectors.softmax(v(0, 0)).alias("s"))
    assert (r["a"], r["b"], r["c"], r["s"]) == (1, 2, -1, [0.5, 0.5])


def body(**points):
    names = {"ls": 5, "rs": 6, "lw": 9, "rw": 10, "lh": 11, "rh": 12}
    held = {names[k]: p for k, p in points.items()}
    return F.array(*[F.struct(F.lit(float(held.get(i, (0, 0))[0])).alias("x"), F.lit(float(held.get(i, (0, 0))[1])).alias("y"), F.lit(0.9 if i in held else 0.0).alias("score")) for i in range(17)])


def test_pose_rules(spark):
    standing = body(ls=(90, 100), rs=(110, 100), lh=(92, 200), rh=(108, 200), lw=(80, 50))
    lying = body(ls=(100, 90), rs=(100, 110), lh=(200, 90), rh=(200, 110))
    tilted = body(ls=(100, 100), lh=(200, 200))
    for k, (angle, lies, facing, up) in ((standing, (0, False, "Upright", True)), (lying, (90, True, "Lying", False)), (tilted, (45, False, "Tilted", False)), (body(), (None, False, "Upright", False))):
        r = one(spark, rules.torso_angle(k).alias("a"), rules.is_lying(k).alias("l"), rules.body_orientation(k).alias("o"), rules.is_hands_up(k, 10.0).alias("u"))
        assert (r["l"], r["o"], r["u"]) == (lies, facing, up) and (r["a"] == pytest.approx(angle) if angle is not None else r["a"] is None)


def hand(straight, thumb=None):
    """Points of a hand with the wrist at the origin, fingers upward."""
    pts = [(0.0, 0.0)] * 21
    pts[1], pts[2], pts[3] = (-2.0, -2.0), (-3.0, -4.0), (-4.0, -5.0)
    pts[4] = thumb or ((-8.0, -8.0) if straight[0] else (0.0, -4.0))
    for f in range(1, 5):
        x = -2.0 + f
        pts[1 + 4 * f], pts[2 + 4 * f], pts[3 + 4 * f] = (x, -6.0), (x, -8.0), (x, -10.0 if straight[f] else -7.0)
        pts[4 + 4 * f] = (x, -12.0) if straight[f] else (x, -5.0)
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(0.9).alias("score")) for x, y in pts])


def test_gestures(spark):
    for straight, label in (((0, 0, 0, 0, 0), "Fist"), ((1, 1, 1, 1, 1), "Open_Palm"), ((0, 1, 1, 0, 0), "Victory"), ((0, 1, 0, 0, 0), "Pointing_Up"), ((0, 1, 1, 1, 0), "Three"), ((0, 1, 1, 1, 1), "Four")):
        assert one(spark, rules.gesture(hand(straight)).alias("g"))["g"]["label"] == label
    assert one(spark, rules.gesture(hand((1, 0, 0, 0, 0), (-4.0, -14.0))).alias("g"))["g"]["label"] == "Thumb_Up"
    with pytest.raises(Exception, match="21 keypoints"):
        one(spark, rules.gesture(F.slice(hand((0,) * 5), 1, 20)))


def test_plate_colours(spark):
    for bgr, name in (((200, 60, 30), "blue"), ((60, 200, 60), "green"), ((20, 180, 220), "yellow"), ((240, 240, 240), "white"), ((20, 20, 20), "black"), ((150, 100, 150), "unknown")):
        assert one(spark, rules.plate_colour(*[F.lit(float(c)) for c in bgr]).alias("c"))["c"] == name


def test_priors(spark):
    plate, qr, palm = slicing.plate_priors(spark), slicing.qr_priors(spark), slicing.palm_anchors(spark)
    assert (plate.count(), qr.count(), palm.count()) == (16_800, 8_112, 2_016)
    assert plate.agg(F.count_distinct("prior_idx"), F.max("cx"), F.min("cx")).first()[0] == 16_800
    assert plate.where("cx < 0 or cx > 1 or cy < 0 or cy > 1").isEmpty()


def loop_slices(h, w, sh, sw, oh, ow):
    out, y1, y0 = [], 0, 0
    while y1 < h:
        x0 = x1 = 0
        y1 = y0 + sh
        while x1 < w:
            x1 = x0 + sw
            if y1 > h or x1 > w:
                x1, y1 = min(x1, w), min(y1, h)
                x0, y0 = max(x1 - sw, 0), max(y1 - sh, 0)
            out.append((x0, y0, x1, y1))
            x0 = x1 - ow
        y0 = y1 - oh
    return out


def test_slices(spark):
    rng = random.Random(3)
    sizes = [(i, rng.randint(1, 900), rng.randint(1, 900)) for i in range(60)]
    got = slicing.slice_grid(spark.createDataFrame(sizes, "image_id long, h int, w int"), 200, 300, 40, 60).orderBy("image_id", "slice_no").collect()
    for i, h, w in sizes:
        assert [tuple(r)[2:] for r in got if r["image_id"] == i] == loop_slices(h, w, 200, 300, 40, 60)


def test_sequences(spark):
    t = lambda *x: F.array(*map(F.lit, x))
    r = one(spark, sequences.table_html(t("<tr>", "<td", ' colspan="3"', ">", "</td>", "<td></td>", "</tr>", "<tr>", "<td></td>", "</tr>", ">")).alias("t"))["t"]
    assert tuple(r) == ('<html><body><table><tr><td colspan="3"></td><td></td></tr><tr><td></td></tr>></table></body></html>', 2, 4)
    assert len(sequences.STRUCTURE_TOKENS) == 48
    assert one(spark, sequences.structure_tokens(t(0, 5, 48, 49, 5)).alias("s"))["s"] == ["<tr>", "<td></td>"]
    frames = spark.createDataFrame([(1, i, b, p) for i, (b, p) in enumerate([(1, 0.5), (1, 0.9), (0, 0.9), (1, 0.7), (2, 0.6), (9, 0.2)])] + [(2, 0, 0, 0.9)], "line_id int, t int, best int, prob double")
    chars = spark.createDataFrame([(1, "a"), (2, "b")], "idx int, char string")
    got = {r["line_id"]: (r["text"], r["score"]) for r in sequences.ctc_decode(frames, 0, dictionary=chars).collect()}
    assert got[1] == ("aab", pytest.approx(0.5)) and got[2] == ("", 0.0)
    kp = [[(float(i), float(k), 1.0) for k in range(17)] for i in range(40)]
    rows = spark.createDataFrame([(1, i, k) for i, k in enumerate(kp)] + [(2, 0, kp[0])], "seq_id int, frame_no int, keypoints array<struct<x: float, y: float, score: float>>")
    window = sequences.skeleton_window(rows).collect()
    assert sorted(r["t"] for r in window if r["seq_id"] == 1) == list(range(30)) and len(window) == 31
    first = next(r for r in window if r["seq_id"] == 1 and r["t"] == 0)["joints"]
    assert first[0]["y"] == pytest.approx(8 * 0.6 / 29) and first[1]["score"] == 1.0 and len(first) == 18


def test_components(spark):
    plane = ["##...", "##..#", "....#", "#...."]
    rows = [(1, y, x, 1.0 if c == "#" else 0.0) for y, line in enumerate(plane) for x, c in enumerate(line)]
    got = planes.components(spark.createDataFrame(rows, "image_id int, y int, x int, v double")).orderBy("component").collect()
    assert [(r["area"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in got] == [(4, 0, 0, 1, 1), (2, 4, 1, 4, 2), (1, 0, 3, 0, 3)]
    assert abs(got[1]["angle"]) == pytest.approx(math.pi / 2)


def test_raster_kernels():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (9, 7, 3), dtype=np.uint8)
    assert (raster.resize(a, 7, 9) == a).all() and raster.resize(a, 3, 4, "area").shape == (4, 3, 3)
    flat = np.full((6, 6, 3), 77, np.uint8)
    for kind in ("nearest", "bilinear", "cubic", "area"):
        assert (raster.resize(flat, 11, 4, kind) == 77).all()
    assert raster.resize_within(a, 100, 100).shape == a.shape and raster.resize_within(a, 3, 100).shape == (4, 3, 3)
    with pytest.raises(InvalidArgument):
        raster.convert_colour(a, "gray2bgr")
    with pytest.raises(InvalidArgument):
        raster.crop(a, 5, 0, 3, 3)
    assert (raster.paste(flat, np.zeros((3, 3, 3), np.uint8), 4, -1)[:2, 4:] == 0).all()
    ones = np.full((5, 5, 1), 255, np.uint8)
    rect = raster.structuring_element("rect", 3, 3)
    assert raster.morphology(ones, "erode", rect)[..., 0].sum() == 9 * 255 and (raster.morphology(ones, "dilate", rect) == 255).all()
    h = raster.homography([(0, 0), (1, 0), (1, 1), (0, 1)], [(10, 10), (30, 12), (28, 40), (8, 35)])
    p = h @ np.array([1, 1, 1])
    assert p[:2] / p[2] == pytest.approx((28, 40)) and raster.homography([(0, 0)] * 4, [(0, 0)] * 4) is None
    assert (raster.warp_quad(flat, np.array([(1, 1), (5, 1), (5, 5), (1, 5)]), 4, 4) == 77).all()
    assert (raster.tiled(a, lambda t: t, 4, 2) == a).all() and (raster.tiled(flat, lambda t: np.repeat(np.repeat(t, 2, 0), 2, 1), 4, 1, 2) == 77).all()
    assert raster.rasterize([(1, 1), (4, 1), (4, 3), (1, 3)], 6, 5).sum() == 6
    assert raster.on_checkerboard(raster.cutout(flat, np.zeros((6, 6))), 3)[0, 0, 0] == 200
    assert (raster.border(flat, 1, 2, 3, 4) == 77).all() and raster.box_blur(flat)[0, 0, 0] == 77
    a_, b_, tx, ty = rules.similarity_transform([(0, 0), (1, 0), (0, 1)], [(5, 5), (5, 7), (3, 5)])
    assert (a_, b_, tx, ty) == pytest.approx((0, 2, 5, 5))


def test_preprocess():
    image = np.full((50, 100, 3), 255, np.uint8)
    out = preprocess(image, PRESETS["letterbox"])
    assert out.shape == (3, 640, 640) and out[0, 0, 0] == pytest.approx(114 / 255) and out[0, 320, 320] == 1
    for name, spec in PRESETS.items():
        assert np.isfinite(preprocess(image, spec)).all(), name
    assert preprocess(image, PRESETS["text_line"])[0, 0, -1] == 0
    assert preprocess(image, PreprocessSpec(fit="keep", align=32)).shape == (3, 64, 128)


def test_images_and_sources(spark, tmp_path):
    rows = [(1, 2, 2, 3, bytes(range(12))), (2, 2, 2, 3, b"short")]
    images = spark.createDataFrame(rows, "image_id long, width int, height int, channels int, data binary")
    got = {r["image_id"]: r for r in raster.map_images(images, lambda a: raster.convert_colour(a, "bgr2gray")).collect()}
    assert got[1]["channels"] == 1 and "InvalidArgument" in got[2]["error"]
    long = tables.pixels(images.where("image_id = 1"))
    assert [r["v"] for r in long.orderBy("y", "x", "channel").collect()] == list(range(12))
    assert tables.export_ppm(images.where("image_id = 1"), str(tmp_path / "ppm")) == 1
    tables.write_images(images, str(tmp_path / "images"))
    assert spark.read.parquet(str(tmp_path / "images")).count() == 2
    (tmp_path / "dict.txt").write_text("a\nb\n\n")
    assert [tuple(r) for r in tables.read_dictionary(spark, str(tmp_path / "dict.txt")).collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "none.txt").write_text("\n")
    with pytest.raises(InvalidArgument):
        tables.read_dictionary(spark, str(tmp_path / "none.txt"))
    (tmp_path / "concepts.txt").write_text("# c\ncat\n\n  dog \n")
    assert [r["concept"] for r in tables.read_concepts(spark, str(tmp_path / "concepts.txt")).collect()] == ["cat", "dog"]
    (tmp_path / "t.f32").write_bytes(np.array([1.5, -2], "<f4").tobytes())
    assert tables.read_tensors(spark, str(tmp_path / "t.f32")).first()["f32"] == [1.5, -2.0]
    vocabulary = {w: i for i, w in enumerate(["[CLS]", "[SEP]", "[UNK]", "cat", "##s", "."])}
    assert tables.wordpiece("Cats dog .", vocabulary) == [0, 3, 4, 2, 5, 1]
    parts = pipelines.crops(images.where("image_id = 1"), spark.createDataFrame([(1, 7, 1.0, 0.0, 2.0, 2.0)], "image_id long, det_id long, x1 double, y1 double, x2 double, y2 double")).first()
    assert (parts["width"], parts["height"], bytes(parts["data"])) == (1, 2, bytes([3, 4, 5, 9, 10, 11]))


def test_scoring(spark, tmp_path):
    path = tmp_path / "softmax.onnx"
    path.write_bytes(scoring.micro_model("Softmax", 4, {"names": "{0: 'a', 1: 'b'}"}, axis=1))
    rows = spark.createDataFrame([(i, [float(i), 0.0, 1.0, 2.0]) for i in range(20)], "image_id long, v array<float>")
    got = scoring.output(scoring.score_vectors(rows, scoring.onnx_scorer(str(path)), "v")).join(rows, "image_id").select("f32", vectors.softmax(F.col("v")).alias("s")).collect()
    assert len(got) == 20 and all(np.allclose(r["f32"], r["s"], atol=1e-6) for r in got)
    assert "names" in [r["name"] for r in scoring.describe_model(spark, str(path)).collect()]
    with pytest.raises(ModelNotFound):
        scoring.open_session(str(tmp_path / "none.onnx"))
    with pytest.raises(InvalidArgument):
        scoring.open_session(" ")
    images = spark.createDataFrame([(1, 4, 4, 3, bytes(48)), (2, 4, 4, 3, b"x")], "image_id long, width int, height int, channels int, data binary")

    def open_scorer():
        # one box a model: [cx, cy, w, h, two class scores] by channels
        return lambda batch: [("out", np.tile(np.array([[16], [16], [8], [8], [0.2], [0.9]], np.float32)[None], (len(batch), 1, 1)))]

    found = engines.detect(images, open_scorer, 2, width=32, height=32).collect()
    assert [(r["image_id"], r["class_id"], r["x1"], r["x2"]) for r in found] == [(1, 1, 1.5, 2.5)]
    errors = scoring.score_images(images, open_scorer, PRESETS["stretch"]).where("error is not null").collect()
    assert [r["image_id"] for r in errors] == [2]
    with pytest.raises(Unsupported):
        engines.require_image("gesture")
    assert len(engines.ENGINES) >= 42


def test_sliced_detection(spark):
    images = spark.createDataFrame([(1, 100, 60, 1, bytes(6000))], "image_id long, width int, height int, channels int, data binary")

    def predict(parts):
        return parts.select("image_id", F.lit(0).alias("class_id"), F.lit(0.9).alias("score"), F.lit(10.0).alias("x1"), F.lit(10.0).alias("y1"), F.lit(30.0).alias("x2"), F.lit(30.0).alias("y2"))

    for merge in ("nms", "greedy", "transitive"):
        got = pipelines.sliced_detection(images, predict, 60, 0.2, merge).select("x1", "x2").collect()
        assert sorted(r["x1"] for r in got) == [10.0, 50.0]
    assert pipelines.sliced_detection(images, predict, 60, 0.2, exclude=(0,)).isEmpty()
    with pytest.raises(InvalidArgument):
        pipelines.enhance(images, {})


def test_streams(spark, tmp_path):
    source = tmp_path / "frames"
    frames = spark.createDataFrame([(s, i, float(i)) for s in (1, 2) for i in range(5 * s)], "seq_id long, frame_no long, value double")
    frames.write.parquet(str(source))
    stream = spark.readStream.schema(frames.schema).parquet(str(source))
    query = batches.recent_frames(stream, 4).writeStream.format("memory").queryName("recent").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(15)  # a stream with timeouts runs on
    query.stop()
    got = {r["seq_id"]: r["frames"] for r in spark.table("recent").collect()}
    assert got == {1: [1, 2, 3, 4], 2: [6, 7, 8, 9]}


def test_text(spark):
    r = one(spark, text.parse_labels(F.lit("{0: 'cat', 1: \"dog\", 2: ''}")).alias("a"), text.parse_labels(F.lit("cat, dog,,")).alias("b"), text.normalize_prompt(F.lit(" A Cat ")).alias("c"), text.attribute_span(F.lit(' colspan="12"'), "colspan").alias("d"), text.attribute_span(F.lit(""), "colspan").alias("e"))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == (["cat", "dog"], ["cat", "dog", "", ""], "a cat .", 12, None)
    tokens = F.array(*map(F.lit, ["[CLS]", "red", "cat", ".", "dog", ".", "[SEP]"]))
    assert one(spark, text.phrase_around(tokens, F.lit(2), [".", "[CLS]", "[SEP]"]).alias("p"))["p"] == "red cat"
    inside = geometry.inside_polygon(F.lit(2.0), F.lit(2.0), F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))]))
    assert one(spark, inside.alias("i"))["i"]


def test_matching(spark):
    scores = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.8), (1, 1, 0, 0.95), (1, 1, 1, 0.1), (1, 2, 2, 0.05)], "pair_id int, a int, b int, score double")
    assert [(r["a"], r["b"]) for r in search.mutual_matches(scores).collect()] == [(1, 0)]
    rows = decode.anchors(spark.createDataFrame([(1, [float(x) for x in (10, 20, 10, 20, 4, 4, 4, 4, 0.9, 0.1, 0.2, 0.3)])], "image_id long, f32 array<float>"), "f32", 6)
    got = decode.decode_centre_boxes(rows, 2).collect()
    assert [(r["anchor"], r["class_id"], r["x1"], r["y2"]) for r in got] == [(0, 0, 8.0, 12.0)]
