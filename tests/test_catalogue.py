"""Registered queries over tables of a test's own."""

from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest

from pixelyard import catalogue
from pixelyard.operators import planes, suppression


def test_gallery_search_takes_each_hundredth_id(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors, labels = rng.normal(size=(730, 64)), rng.integers(0, 9, 730).tolist()
    rows = [(i, v.tolist(), label) for i, (v, label) in enumerate(zip(vectors, labels))]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["query_id"], r["rank"]): (r["id"], r["similarity"]) for r in catalogue.QUERIES["gallery_search_topk"](spark, str(tmp_path)).collect()}
    assert {q for q, _ in got} == set(range(0, 730, 100)) and len(got) == 3 * 8
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    for q in range(0, 730, 100):
        best = {}
        for label, s in zip(labels, (units @ units[q]).tolist()):
            best[label] = max(s, best.get(label, -1))
        for rank, (label, s) in enumerate(sorted(best.items(), key=lambda x: -x[1])[:3], 1):
            assert got[q, rank] == (label, pytest.approx(s, abs=2e-6))


def flood(plane, limit):
    """Regions in order of discovery, pixel by pixel."""
    on, found = {(y, x) for y, row in enumerate(plane) for x, v in enumerate(row) if v > limit}, []
    while on:
        work = [min(on)]
        on -= set(work)
        region = []
        while work:
            y, x = work.pop()
            region.append((y, x))
            near = {(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)} & on
            on -= near
            work += near
        found.append(region)
    return found


def test_components_of_many_planes(spark):
    rng = np.random.default_rng(3)
    shown = {i: rng.random((int(rng.integers(1, 12)), int(rng.integers(1, 12)))) for i in range(40)}
    spiral = np.zeros((9, 9))
    spiral[0, :] = spiral[:, 8] = spiral[8, :] = spiral[2:, 0] = spiral[2, :7] = spiral[2:7, 6] = spiral[6, 2:7] = spiral[4:7, 2] = spiral[4, 2:5] = 1
    shown |= {40: spiral, 41: np.ones((1, 30)), 42: np.zeros((3, 3))}
    rows = [(i, y, x, float(v)) for i, plane in shown.items() for (y, x), v in np.ndenumerate(plane)] + [(43, 0, 0, None)]
    got = planes.components(spark.createDataFrame(rows, "image_id long, y int, x int, v double"), 0.6).collect()
    right = {}
    for i, plane in shown.items():
        for k, region in enumerate(flood(plane, 0.6)):
            ys, xs = zip(*region)
            right[i, k] = (len(region), min(xs), min(ys), max(xs), max(ys), pytest.approx(float(np.mean([plane[p] for p in region]))))
    assert {(r["image_id"], r["component"]): tuple(r)[2:8] for r in got} == right and len(got) == len(right)
    line = next(r for r in got if r["image_id"] == 41)
    assert line["angle"] == 0.0


def embeddings(spark, folder, vectors):
    rows = [(i, v.tolist(), i % 10) for i, v in enumerate(vectors.astype(np.float32))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def rows_of_both(spark, name, folder, *tables):
    """Rows of a query and of its SQL, by the columns of the SQL."""
    duck = duckdb.connect()
    for table in tables:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    right = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in right.description]
    return Counter(tuple(r) for r in catalogue.QUERIES[name](spark, folder).select(*columns).collect()), Counter(right.fetchall())


GRAY_QUERIES = "box_crops class_histogram connected_components constant_border dilate erode gray_to_bgr image_quality mask_boxes mask_unions min_max_loc resize_area threshold_and_scale".split()


@pytest.fixture(scope="module")
def just_below(spark, tmp_path_factory):
    """Values below a whole gray level by less than single precision tells at that level."""
    levels = np.random.default_rng(1).integers(2, 60, (24, 64)) * np.random.default_rng(2).choice([-1, 1], (24, 64))
    levels[:, ::7] = 23
    return embeddings(spark, tmp_path_factory.mktemp("below"), np.nextafter(np.float32(levels / 256), np.float32(-1)))


@pytest.mark.parametrize("name", GRAY_QUERIES)
def test_gray_levels_are_those_of_the_sql(spark, just_below, name):
    got, right = rows_of_both(spark, name, just_below, "embeddings")
    assert got == right


def test_gestures_of_equal_scores(spark, tmp_path):
    """Row 330's patterns Open_Palm and Three have one score, but for its last bits."""
    vectors = np.random.default_rng(7).normal(size=(340, 64))
    folder = embeddings(spark, tmp_path, vectors / np.linalg.norm(vectors, axis=1)[:, None])
    got, right = rows_of_both(spark, "gesture_rules", folder, "embeddings")
    assert got == right and any(id == 330 and label == "Open_Palm" for id, label, _ in got)


def test_overlapping_pairs_without_a_join(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 60)), int(rng.integers(0, 9)), int(rng.integers(0, 9)), i % 7, float(rng.integers(1, 51)), i / 8, 0.0, 0.0, None) for i in range(500)]
    rows += [(9001, 0, 0, 0, 20.0, 0.0, 0.0, 0.0, None), (9002, 200, 3, 0, 26.0, 0.0, 0.0, 0.0, None)]
    rows += [(9100 + k // 40, p, s, 0, float(q), k / 8, 0.0, 0.0, None) for k, (p, s, q) in enumerate(rng.integers([0, 0, 1], [200, 200, 51], (4000, 3)).tolist())]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    got, right = rows_of_both(spark, "overlapping_pairs", str(tmp_path), "lineitem")
    assert got == right and len(got) > 300
    assert "Join" not in catalogue.QUERIES["overlapping_pairs"](spark, str(tmp_path))._jdf.queryExecution().toString()


def test_pairs_of_one_large_class(spark):
    rng = np.random.default_rng(6)
    corner, size = rng.integers(0, 400, (900, 2)).astype(float), rng.integers(0, 60, (900, 2)).astype(float)
    boxes = [(1, i % 2, i, *a, *b) for i, (a, b) in enumerate(zip(corner.tolist(), (corner + size).tolist()))]
    odd = [(2, 0, 0, 0.0, 0.0, None, 9.0), (2, 0, 1, 0.0, 0.0, 9.0, 9.0), (2, None, 2, 0.0, 0.0, 9.0, 9.0), (3, 0, 0, 5.0, 5.0, 5.0, 5.0), (3, 0, 1, 5.0, 5.0, 5.0, 5.0)]
    frame = spark.createDataFrame(boxes + odd, "image_id long, class_id int, seq int, x1 double, y1 double, x2 double, y2 double")
    got = {tuple(r)[:3]: r["iou"] for r in suppression.overlapping_pairs(frame).collect()}
    right = {}
    for (_, k, i, *a), (_, m, j, *b) in combinations(boxes, 2):
        inter = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
        base = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
        if k == m and base > 0 and inter / base > 0.5:
            right[1, i, j] = pytest.approx(inter / base)
    assert got == right and right
