"""Registered queries: each applies an operator to a whole table; each oracle is the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import geometry, rules, text, vectors
from .operators import decode, masks, planes, raster, search, sequences, slicing, suppression
from .plans import pipelines, scoring
from .sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return register


def r6(c):
    return F.round(c, 6)


# ---- search and matching

COSINE = "list_cosine_similarity(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(g.embedding, lambda x: x::DOUBLE))"


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, g.label AS id, max({COSINE}) AS s FROM embeddings q, embeddings g WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s) SELECT query_id, id, CAST(rank AS INT) AS rank, round(s, 6) AS similarity FROM r WHERE rank <= 3""")
def gallery_search_topk(spark, sf_dir):
    """Each vector whose id is divisible by 100 as a query against a gallery of all vectors, by label."""
    rows = fx.table(spark, sf_dir, "embeddings")
    found = search.gallery_search(rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), rows, 3, entry_id="label")
    return found.select("query_id", F.col("label").alias("id"), "rank", r6("similarity").alias("similarity"))


@query(f"WITH {fx.SQL_LOGITS} SELECT id, k, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 7) AS v FROM logits")
def l2_normalize(spark, sf_dir):
    return fx.scores(spark, sf_dir).select("id", F.posexplode(vectors.l2_normalize(F.col("scores"))).alias("k", "v")).withColumn("v", F.round("v", 7))


PAIRS = "pairs AS (SELECT a.label AS pair_id, a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)"


def features(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings").select(F.col("label").alias("pair_id"), F.col("vec_id").alias("idx"), "embedding")
    return search.score_matrix(rows.where("idx % 2 = 0"), rows.where("idx % 2 = 1"))


@query(f"WITH {PAIRS} SELECT pair_id, a, b, round(score, 6) AS score FROM pairs")
def feature_score_matrix(spark, sf_dir):
    """Even vectors of a label as one image's features, odd ones as the other's."""
    return features(spark, sf_dir).select("pair_id", "a", "b", r6("score").alias("score"))


@query(f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, a ORDER BY round(score, 9) DESC, b) AS ra, row_number() OVER (PARTITION BY pair_id, b ORDER BY round(score, 9) DESC, a) AS rb FROM pairs)
SELECT pair_id, a, b, round(score, 6) AS score FROM r WHERE ra = 1 AND rb = 1 AND score >= 0.1""")
def mutual_nearest_matches(spark, sf_dir):
    found = search.mutual_matches(features(spark, sf_dir).withColumn("score", F.round("score", 9)))
    return found.select("pair_id", "a", "b", r6("score").alias("score"))


ORDERED_MATCHES = "m AS (SELECT l_orderkey // 20 AS pair_id, row_number() OVER (PARTITION BY l_orderkey // 20 ORDER BY " + fx.BOX_ORDER + ") AS match_no, CAST(l_partkey % 40 AS INT) AS idx0, CAST(l_suppkey % 40 AS INT) AS idx1, l_discount AS score FROM lineitem), f AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY match_no) AS n FROM m WHERE score > 0.02)"


@query(f"""WITH RECURSIVE {ORDERED_MATCHES}, step AS (
SELECT pair_id, n, [idx0] AS u0, [idx1] AS u1, true AS keep, match_no, idx0, idx1 FROM f WHERE n = 1
UNION ALL SELECT f.pair_id, f.n, CASE WHEN ok THEN list_append(u0, f.idx0) ELSE u0 END, CASE WHEN ok THEN list_append(u1, f.idx1) ELSE u1 END, ok, f.match_no, f.idx0, f.idx1
FROM (SELECT s.pair_id, s.n, s.u0, s.u1, g.idx0, NOT list_contains(s.u0, g.idx0) AND NOT list_contains(s.u1, g.idx1) AS ok FROM step s JOIN f g ON g.pair_id = s.pair_id AND g.n = s.n + 1) s JOIN f ON f.pair_id = s.pair_id AND f.n = s.n + 1)
SELECT pair_id, match_no, idx0, idx1 FROM step WHERE keep""")
def one_to_one_matches(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey div 20 AS pair_id", f"row_number() OVER (PARTITION BY l_orderkey div 20 ORDER BY {fx.BOX_ORDER}) AS match_no", "CAST(l_partkey % 40 AS INT) AS idx0", "CAST(l_suppkey % 40 AS INT) AS idx1", "l_discount AS score")
    return suppression.one_to_one(rows, threshold=0.02).select("pair_id", "match_no", "idx0", "idx1")


@query(f"WITH {fx.SQL_LOGITS}, d AS (SELECT id, k, v, k // 8 AS y, k % 8 AS x FROM logits) SELECT id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, v AS overlap FROM d WHERE y % 2 = 0 AND x % 2 = 0 AND v >= 0.05 AND abs(v * 4) <= 1")
def dense_grid_samples(spark, sf_dir):
    dense = fx.scores(spark, sf_dir).select("id", F.posexplode("scores").alias("k", "overlap")).select("id", F.floor(F.col("k") / 8).cast("int").alias("y"), (F.col("k") % 8).alias("x"), (F.col("overlap") * 4).alias("nx"), (F.col("overlap") * -4).alias("ny"), "overlap")
    return search.grid_samples(dense, 2, 0.05).select("id", "y", "x", "overlap")


# ---- classification and scores


@query(f"WITH {fx.SQL_LOGITS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, k) AS rank FROM logits) SELECT id AS image_id, CAST(rank AS INT) AS rank, k AS class_id, v AS score FROM r WHERE rank <= 5")
def classify_topk(spark, sf_dir):
    return decode.from_scores(fx.scores(spark, sf_dir).withColumnRenamed("id", "image_id"), 5)


@query("SELECT vec_id AS id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS class_id, CAST(64 - list_position(list_reverse(embedding), list_max(embedding)) AS INT) AS last_id, list_max(embedding)::DOUBLE AS score FROM embeddings WHERE list_max(embedding)::DOUBLE >= 0.2")
def classify_top1(spark, sf_dir):
    rows = fx.scores(spark, sf_dir).where(decode.passes(F.array_max("scores"), "classification", 0.2))
    return rows.select("id", vectors.argmax(F.col("scores")).alias("class_id"), vectors.argmax_last(F.col("scores")).alias("last_id"), F.array_max("scores").alias("score"))


@query(f"WITH {fx.SQL_LOGITS}, e AS (SELECT id, k, exp(v - max(v) OVER (PARTITION BY id)) AS e FROM logits) SELECT id, k, round(e / sum(e) OVER (PARTITION BY id), 7) AS p FROM e")
def softmax_probabilities(spark, sf_dir):
    return fx.scores(spark, sf_dir).select("id", F.posexplode(vectors.softmax(F.col("scores"))).alias("k", "p")).select("id", "k", F.round("p", 7).alias("p"))


@query(f"WITH {fx.SQL_LOGITS}, b AS (SELECT id, min(v) AS lo FROM logits GROUP BY id) SELECT id, k, round(CASE WHEN lo < -0.3 THEN 1 / (1 + exp(-v)) ELSE v END, 7) AS p FROM logits JOIN b USING (id)")
def sigmoid_if_needed(spark, sf_dir):
    return fx.scores(spark, sf_dir).select("id", F.posexplode(vectors.sigmoid_if_needed(F.col("scores"), low=-0.3)).alias("k", "p")).select("id", "k", F.round("p", 7).alias("p"))


@query(f"WITH {fx.SQL_LOGITS}, l AS (SELECT vec_id AS id, label FROM embeddings), m AS (SELECT label, k, avg(v) AS m FROM logits JOIN l USING (id) GROUP BY 1, 2) SELECT label, k, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS v FROM m")
def embedding_prototypes(spark, sf_dir):
    found = vectors.mean_vector(fx.table(spark, sf_dir, "embeddings"), "label", "embedding")
    return found.select("label", F.posexplode("prototype").alias("k", "v")).select("label", "k", r6("v").alias("v"))


@query("SELECT o_orderkey AS id, o_custkey % 40 AS class_id, coalesce(n_name, CAST(o_custkey % 40 AS VARCHAR)) AS class_name FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 40")
def label_lookup(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey % 40 AS class_id")
    return decode.with_labels(rows, fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("class_id"), F.col("n_name").alias("name")))


@query("""WITH t AS (SELECT p_partkey, '{0: ''' || p_brand || ''', 1: "' || p_type || '", 2: ''''}' AS d, p_brand || ', ' || p_type || ' ,,' || p_size AS c FROM part)
SELECT p_partkey, list_aggregate(list_filter([trim(x) for x in regexp_extract_all(d, '[''"]([^''"]*)[''"]', 1)], lambda s: s <> ''), 'string_agg', '|') AS quoted, list_aggregate([trim(x) for x in string_split(c, ',')], 'string_agg', '|') AS listed FROM t""")
def parse_labels(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "part").selectExpr("p_partkey", """concat("{0: '", p_brand, "', 1: \\"", p_type, "\\", 2: ''}") AS d""", "concat(p_brand, ', ', p_type, ' ,,', p_size) AS c")
    return rows.select("p_partkey", F.array_join(text.parse_labels(F.col("d")), "|").alias("quoted"), F.array_join(text.parse_labels(F.col("c")), "|").alias("listed"))


# ---- boxes

INTER = "greatest(least(k.x2, c.x2) - greatest(k.x1, c.x1), 0) * greatest(least(k.y2, c.y2) - greatest(k.y1, c.y1), 0)"
AREA = "({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1)"
UNION = f"({AREA.format('k')} + {AREA.format('c')} - {INTER})"


def named(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({"img": "image_id", "cls": "class_id"})


@query(f"WITH {fx.SQL_BOXES} SELECT img, cls, seq, score FROM boxes WHERE score >= 0.5")
def confidence_filter(spark, sf_dir):
    return fx.boxes(spark, sf_dir).where(decode.passes(F.col("score"), "detection", 0.5)).select("img", "cls", "seq", "score")


@query(f"WITH {fx.SQL_BOXES} SELECT img, seq, least(greatest(x1 - (x2 - x1) / 2, 0), 150) AS x1, least(greatest(y1 - (y2 - y1) / 2, 0), 120) AS y1, least(greatest(x1 + (x2 - x1) / 2, 0), 150) AS x2, least(greatest(y1 + (y2 - y1) / 2, 0), 120) AS y2 FROM boxes")
def centre_boxes_clipped(spark, sf_dir):
    rows = fx.boxes(spark, sf_dir).withColumn("b", geometry.from_centre(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    return rows.select("img", "seq", geometry.clip(F.col("b"), F.lit(150), F.lit(120)).alias("b")).select("img", "seq", "b.*")


@query(f"WITH {fx.SQL_BOXES}, {fx.SQL_SIZES}, f AS (SELECT img, least(640.0::DOUBLE / w, 640.0::DOUBLE / h) AS r, w, h FROM sizes), g AS (SELECT *, round(w * r) AS nw, round(h * r) AS nh FROM f), p AS (SELECT img, r, round((640 - nw) / 2 - 0.1::DOUBLE) AS l, round((640 - nh) / 2 - 0.1::DOUBLE) AS t FROM g) SELECT b.img, seq, round((x1 - l) / r, 9) AS x1, round((y1 - t) / r, 9) AS y1, round((x2 - l) / r, 9) AS x2, round((y2 - t) / r, 9) AS y2 FROM boxes b JOIN p ON p.img = b.img")
def letterbox_restore(spark, sf_dir):
    fit = fx.image_sizes(spark, sf_dir).select("img", geometry.letterbox(F.col("w"), F.col("h"), 640, 640).alias("fit"))
    rows = fx.boxes(spark, sf_dir).join(fit, "img").withColumn("b", geometry.restore(F.struct("x1", "y1", "x2", "y2"), F.col("fit")))
    return rows.select("img", "seq", *[F.round(f"b.{c}", 9).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(f"""WITH {fx.SQL_BOXES.replace(' AS (', ' AS MATERIALIZED (', 1)}, lists AS MATERIALIZED (SELECT img, list(struct_pack(seq := seq, x1 := x1, y1 := y1, x2 := x2, y2 := y2)) AS bs FROM boxes GROUP BY img, cls),
firsts AS (SELECT img, unnest(bs) AS k, bs FROM lists), pairs AS (SELECT img, k, unnest(list_filter(bs, lambda b: b.seq > k.seq)) AS c FROM firsts)
SELECT img, k.seq AS a, c.seq AS b, round({INTER} / {UNION}, 6) AS iou, round({INTER} / least({AREA.format('k')}, {AREA.format('c')}), 6) AS ios FROM pairs WHERE {INTER} / {UNION} > 0.5""")
def overlapping_pairs(spark, sf_dir):
    found = suppression.overlapping_pairs(fx.boxes(spark, sf_dir), 0.5, image="img", class_col="cls")
    return found.select("img", "a", "b", *[(F.round(F.col(c) * 1e6) / 1e6).alias(c) for c in ("iou", "ios")])  # a half in decimals may be less in binary


def nms_sql(partition: str, order: str, hit: str, cap: int | None = None, kept_cap: int | None = None, kind: str = "DOUBLE") -> str:
    source = "boxes" if cap is None else f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC, seq) AS place FROM boxes) WHERE place <= {cap})"
    sides = ", ".join(f"{c}::{kind} AS {c}" for c in ("x1", "y1", "x2", "y2"))
    struct = "struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2)"
    full = "" if kept_cap is None else f" OR len(s.kept) >= {kept_cap}"
    by = partition.split(", ")
    join = " AND ".join(f"s.{p} = o.{p}" for p in by)
    return f"""WITH RECURSIVE {fx.SQL_BOXES}, o AS (SELECT img, cls, seq, score, {sides}, row_number() OVER (PARTITION BY {partition} ORDER BY {order}) AS n FROM {source}),
step AS (SELECT {partition}, n, [{struct}] AS kept, true AS keep, seq AS id FROM o WHERE n = 1
UNION ALL SELECT {", ".join("o." + p for p in by)}, o.n, CASE WHEN d THEN s.kept ELSE list_append(s.kept, struct_pack(x1 := o.x1, y1 := o.y1, x2 := o.x2, y2 := o.y2)) END, NOT d, o.seq
FROM step s JOIN o ON {join} AND o.n = s.n + 1, LATERAL (SELECT len(list_filter(s.kept, lambda k: {hit})) > 0{full} AS d))
SELECT b.img, b.cls, b.seq, b.score FROM step JOIN boxes b ON b.img = step.img AND b.seq = step.id WHERE keep"""


def hit_sql(threshold: str, metric: str = "iou", cmp: str = ">", epsilon: str = "", kind: str = "DOUBLE") -> str:
    zero = f"0::{kind}"
    inter = f"greatest(least(k.x2, o.x2) - greatest(k.x1, o.x1), {zero}) * greatest(least(k.y2, o.y2) - greatest(k.y1, o.y1), {zero})"
    a, b = "(k.x2 - k.x1) * (k.y2 - k.y1)", "(o.x2 - o.x1) * (o.y2 - o.y1)"
    base = f"({a} + {b} - {inter}{epsilon})" if metric == "iou" else f"least({a}, {b})"
    return f"({inter} / {base})::{kind} {cmp} {threshold}::{kind}"


def survivors(spark, sf_dir, variant: str, **changes) -> DataFrame:
    return suppression.suppress(fx.boxes(spark, sf_dir), variant, image="img", class_col="cls", **changes).select("img", "cls", "seq", "score")


@query(nms_sql("img, cls", "score DESC, seq", hit_sql("0.45")))
def nms_per_class(spark, sf_dir):
    return survivors(spark, sf_dir, "detection")


@query(nms_sql("img", "score DESC, seq", hit_sql("0.65")))
def nms_class_agnostic(spark, sf_dir):
    return survivors(spark, sf_dir, "pose_one_stage")


@query(nms_sql("img", "score DESC, seq", hit_sql("0.45"), cap=20))
def nms_top_k_first(spark, sf_dir):
    return survivors(spark, sf_dir, "qr", before=20)


@query(nms_sql("img", "score DESC, seq", hit_sql("0.3"), kept_cap=4))
def nms_four_at_most(spark, sf_dir):
    return survivors(spark, sf_dir, "palm")


@query(nms_sql("img, cls", "score DESC, seq", hit_sql("0.5", epsilon=" + 1e-9")))
def tile_deduplication(spark, sf_dir):
    return survivors(spark, sf_dir, "tiles")


@query(nms_sql("img, cls", "score DESC, x1, y1, x2, y2, seq", hit_sql("0.5", "ios", ">=", kind="FLOAT"), kind="FLOAT"))
def slice_nms(spark, sf_dir):
    return survivors(spark, sf_dir, "slices")


SIDES32 = ", ".join(f"{c} := {c}::FLOAT" for c in ("x1", "y1", "x2", "y2"))
KHIT = hit_sql("0.5", "ios", ">=", kind="FLOAT")
MERGE = "(greatest(least(s.x2, m.x2) - greatest(s.x1, m.x1), 0::DOUBLE) * greatest(least(s.y2, m.y2) - greatest(s.y1, m.y1), 0::DOUBLE) / least((s.x2 - s.x1) * (s.y2 - s.y1), (m.x2 - m.x1) * (m.y2 - m.y1))) > 0.5::DOUBLE"


@query(f"""WITH RECURSIVE {fx.SQL_BOXES}, o AS (SELECT img, cls, seq, score, x1::FLOAT AS x1, y1::FLOAT AS y1, x2::FLOAT AS x2, y2::FLOAT AS y2, row_number() OVER (PARTITION BY img, cls ORDER BY score::FLOAT DESC, x1::FLOAT, y1::FLOAT, x2::FLOAT, y2::FLOAT, seq) AS n FROM boxes),
g AS (SELECT img, cls, n, seq, seq AS kid, [struct_pack(id := seq, x1 := x1, y1 := y1, x2 := x2, y2 := y2)] AS ks FROM o WHERE n = 1
UNION ALL SELECT o.img, o.cls, o.n, o.seq, coalesce(h, o.seq), CASE WHEN h IS NULL THEN list_append(s.ks, struct_pack(id := o.seq, x1 := o.x1, y1 := o.y1, x2 := o.x2, y2 := o.y2)) ELSE s.ks END
FROM g s JOIN o ON s.img = o.img AND s.cls = o.cls AND o.n = s.n + 1, LATERAL (SELECT list_filter(s.ks, lambda k: {KHIT})[1].id AS h)),
mem AS (SELECT g.img, g.cls, g.kid, b.x1, b.y1, b.x2, b.y2, b.score, row_number() OVER (PARTITION BY g.img, g.kid ORDER BY g.n) AS j FROM g JOIN boxes b ON b.img = g.img AND b.seq = g.seq),
f AS (SELECT img, cls, kid, j, x1, y1, x2, y2, score, 1 AS members FROM mem WHERE j = 1
UNION ALL SELECT s.img, s.cls, s.kid, m.j, CASE WHEN ok THEN least(s.x1, m.x1) ELSE s.x1 END, CASE WHEN ok THEN least(s.y1, m.y1) ELSE s.y1 END, CASE WHEN ok THEN greatest(s.x2, m.x2) ELSE s.x2 END, CASE WHEN ok THEN greatest(s.y2, m.y2) ELSE s.y2 END, CASE WHEN ok THEN greatest(s.score, m.score) ELSE s.score END, s.members + CASE WHEN ok THEN 1 ELSE 0 END
FROM f s JOIN mem m ON m.img = s.img AND m.kid = s.kid AND m.j = s.j + 1, LATERAL (SELECT {MERGE} AS ok))
SELECT img, cls, kid AS seq, x1, y1, x2, y2, score, CAST(members AS INT) AS members FROM f QUALIFY j = max(j) OVER (PARTITION BY img, kid)""")
def slice_greedy_merge(spark, sf_dir):
    return suppression.greedy_merge(fx.boxes(spark, sf_dir), image="img", class_col="cls").select("img", "cls", "seq", "x1", "y1", "x2", "y2", "score", "members")


@query(f"""WITH RECURSIVE {fx.SQL_BOXES}, o AS (SELECT img, cls, seq, x1::FLOAT AS x1, y1::FLOAT AS y1, x2::FLOAT AS x2, y2::FLOAT AS y2, row_number() OVER (PARTITION BY img, cls ORDER BY score::FLOAT DESC, x1::FLOAT, y1::FLOAT, x2::FLOAT, y2::FLOAT, seq) AS n FROM boxes),
g AS (SELECT img, cls, n, seq, seq AS kid, 0::BIGINT AS taker, [struct_pack(n := n, kid := seq, x1 := x1, y1 := y1, x2 := x2, y2 := y2)] AS ks FROM o WHERE n = 1
UNION ALL SELECT o.img, o.cls, o.n, o.seq, coalesce(h.kid, o.seq), coalesce(h.n, 0), list_append(s.ks, struct_pack(n := o.n, kid := coalesce(h.kid, o.seq), x1 := o.x1, y1 := o.y1, x2 := o.x2, y2 := o.y2))
FROM g s JOIN o ON s.img = o.img AND s.cls = o.cls AND o.n = s.n + 1, LATERAL (SELECT list_filter(s.ks, lambda k: {KHIT})[1] AS h)),
mem AS (SELECT g.img, g.cls, g.kid, b.x1, b.y1, b.x2, b.y2, b.score, row_number() OVER (PARTITION BY g.img, g.kid ORDER BY g.taker, g.n) AS j FROM g JOIN boxes b ON b.img = g.img AND b.seq = g.seq),
f AS (SELECT img, cls, kid, j, x1, y1, x2, y2, score, 1 AS members FROM mem WHERE j = 1
UNION ALL SELECT s.img, s.cls, s.kid, m.j, CASE WHEN ok THEN least(s.x1, m.x1) ELSE s.x1 END, CASE WHEN ok THEN least(s.y1, m.y1) ELSE s.y1 END, CASE WHEN ok THEN greatest(s.x2, m.x2) ELSE s.x2 END, CASE WHEN ok THEN greatest(s.y2, m.y2) ELSE s.y2 END, CASE WHEN ok THEN greatest(s.score, m.score) ELSE s.score END, s.members + CASE WHEN ok THEN 1 ELSE 0 END
FROM f s JOIN mem m ON m.img = s.img AND m.kid = s.kid AND m.j = s.j + 1, LATERAL (SELECT {MERGE} AS ok))
SELECT img, cls, kid AS seq, x1, y1, x2, y2, score, CAST(members AS INT) AS members FROM f QUALIFY j = max(j) OVER (PARTITION BY img, kid)""")
def slice_transitive_merge(spark, sf_dir):
    """A box's keeper is that of the first box above it that it meets."""
    return suppression.transitive_merge(fx.boxes(spark, sf_dir), image="img", class_col="cls")


@query()
def rotated_nms(spark, sf_dir):
    """Boxes turned by their quantity; tests hold the kernel against known areas."""
    rows = fx.boxes(spark, sf_dir).selectExpr("img", "cls", "seq", "(x1 + x2) / 2 AS cx", "(y1 + y2) / 2 AS cy", "x2 - x1 AS w", "y2 - y1 AS h", "radians((x2 - x1) * 7 % 180) AS angle", "score")
    return suppression.rotated_suppression(rows, image="img").select("img", "cls", "seq", "score")


@query(f"WITH {fx.SQL_BOXES} SELECT img, cls, seq, least(x1, 180) AS x1, least(y1, 180) AS y1, least(x2, 180) AS x2, least(y2, 180) AS y2 FROM boxes WHERE cls <> 1 AND least(x1, 180) < least(x2, 180) AND least(y1, 180) < least(y2, 180) UNION ALL SELECT img, cls, seq, x1, y1, x2, y2 FROM boxes WHERE score > 0.9")
def sliced_union_exclude(spark, sf_dir):
    """Slices' boxes without an excluded class, clipped, and those of the full image."""
    rows = fx.boxes(spark, sf_dir)
    part = rows.where("cls <> 1").withColumn("b", geometry.clip(F.struct("x1", "y1", "x2", "y2"), F.lit(180), F.lit(180))).select("img", "cls", "seq", "b.*").where("x1 < x2 and y1 < y2")
    return part.unionByName(rows.where("score > 0.9").select("img", "cls", "seq", "x1", "y1", "x2", "y2"))


# ---- slicing


@query(f"WITH {fx.SQL_SIZES}, y AS (SELECT img, w, h, i AS r, least(i * 410, greatest(h - 512, 0)) AS y_min FROM sizes, range(0, 10) t(i) WHERE i <= ceil(greatest(h - 512, 0) / 410.0)), x AS (SELECT img, i AS c, least(i * 410, greatest(w - 512, 0)) AS x_min, count(*) OVER (PARTITION BY img) AS n FROM sizes, range(0, 10) t(i) WHERE i <= ceil(greatest(w - 512, 0) / 410.0)) SELECT y.img, CAST(r * n + c AS INT) AS slice_no, CAST(x_min AS INT) AS x_min, CAST(y_min AS INT) AS y_min, CAST(least(x_min + 512, w) AS INT) AS x_max, CAST(least(y_min + 512, h) AS INT) AS y_max FROM y JOIN x ON x.img = y.img")
def slice_grid(spark, sf_dir):
    return slicing.slice_images(fx.image_sizes(spark, sf_dir), 512, 0.2, image="img")


@query(f"WITH {fx.SQL_SIZES}, f AS (SELECT *, ceil(log2(w::DOUBLE * h)) - 1 AS e FROM sizes), l AS (SELECT *, CASE WHEN e <= 18 THEN 0 WHEN e < 21 THEN 1 WHEN e < 24 THEN 2 ELSE 4 END AS s FROM f), d AS (SELECT img, s, CASE WHEN s = 0 THEN w WHEN w > h THEN w // (2 * s) ELSE w // s END AS sw, CASE WHEN s = 0 THEN h WHEN w < h THEN h // (2 * s) ELSE h // s END AS sh FROM l) SELECT img, CAST(sw AS INT) AS slice_w, CAST(sh AS INT) AS slice_h, CAST(floor(sw * o) AS INT) AS x_overlap, CAST(floor(sh * o) AS INT) AS y_overlap FROM (SELECT *, (CASE s WHEN 0 THEN 1 WHEN 1 THEN 0.8 ELSE 0.4 END)::DOUBLE AS o FROM d)")
def auto_slice_params(spark, sf_dir):
    return slicing.auto_slice_params(fx.image_sizes(spark, sf_dir)).select("img", "slice_w", "slice_h", "x_overlap", "y_overlap")


@query(f"WITH {fx.SQL_SIZES}, g AS (SELECT img, a * 340 AS x, b * 340 AS y, least(400, w - a * 340) AS tile_w, least(400, h - b * 340) AS tile_h, greatest(w, h) > 400 AS big FROM sizes, range(0, 10) s(a), range(0, 10) t(b) WHERE (a = 0 OR greatest(w, h) > 400) AND (b = 0 OR greatest(w, h) > 400) AND a * 340 < w AND b * 340 < h) SELECT img, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(tile_w AS INT) AS tile_w, CAST(tile_h AS INT) AS tile_h FROM g WHERE NOT big OR (tile_w >= 200 AND tile_h >= 200)")
def tile_grid(spark, sf_dir):
    return slicing.tile_grid(fx.image_sizes(spark, sf_dir), 400, 0.85, 200, image="img")


@query(f"WITH {fx.SQL_SIZES} SELECT img, CAST(a * 128 AS INT) AS x, CAST(b * 128 AS INT) AS y FROM sizes, range(1, 20) s(a), range(1, 20) t(b) WHERE a * 128 < w AND b * 128 < h")
def prompt_grid(spark, sf_dir):
    return slicing.prompt_grid(fx.image_sizes(spark, sf_dir), 128, image="img")


LAYERS = "(VALUES (0, 80, 8, 24, 48, 0), (1, 40, 16, 96, 192, 12800), (2, 20, 32, 384, 768, 16000)) l(layer, cells, step, s0, s1, base)"


@query(f"WITH p AS (SELECT base + i AS prior_idx, ((i // 2) % cells + 0.5::DOUBLE) * step / 640 AS cx, ((i // 2) // cells + 0.5::DOUBLE) * step / 640 AS cy, (CASE WHEN i % 2 = 0 THEN s0 ELSE s1 END)::DOUBLE / 640 AS s FROM {LAYERS}, LATERAL (SELECT unnest(range(0, cells * cells * 2)) AS i)), o AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), d AS (SELECT vec_id, prior_idx, cx + e[1] * 0.1::DOUBLE * s AS x, cy + e[2] * 0.1::DOUBLE * s AS y, s * exp(e[3] * 0.2::DOUBLE) AS w, s * exp(e[4] * 0.2::DOUBLE) AS h FROM o JOIN p ON prior_idx = vec_id % 16800) SELECT vec_id, CAST(prior_idx AS BIGINT) AS prior_idx, round(x - w / 2, 7) AS x1, round(y - h / 2, 7) AS y1, round(x + w / 2, 7) AS x2, round(y + h / 2, 7) AS y2 FROM d")
def ssd_prior_decode(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 16800).alias("prior_idx"), F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("o"))
    return decode.decode_ssd(rows, slicing.plate_priors(spark)).select("vec_id", "prior_idx", *[F.round(c, 7).alias(c) for c in ("x1", "y1", "x2", "y2")])


# ---- sequences

FRAMES8 = f"WITH {fx.SQL_LOGITS}, f AS (SELECT id, k // 8 AS t, k % 8 AS c, v FROM logits), b AS (SELECT id, t, arg_max(c, struct_pack(v := v, m := -c)) AS best, max(v) AS prob FROM f GROUP BY 1, 2)"


def ctc_frames(spark, sf_dir):
    rows = fx.scores(spark, sf_dir).select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("scores", t * 8 + 1, F.lit(8)))).alias("t", "v"))
    return rows.select("id", "t", vectors.argmax(F.col("v")).alias("best"), F.array_max("v").alias("prob"))


def ctc_sql(blank: int) -> str:
    return FRAMES8 + f", e AS (SELECT *, best <> {blank} AND best <> lag(best, 1, {blank}) OVER (PARTITION BY id ORDER BY t) AS emit FROM b) SELECT id, coalesce(string_agg(chr(CAST(97 + best AS INT)), '' ORDER BY t) FILTER (emit), '') AS text, round(coalesce(avg(prob) FILTER (emit), 0), 6) AS score, count(*) FILTER (emit) AS emitted FROM e GROUP BY id"


def ctc(spark, sf_dir, blank: int) -> DataFrame:
    letters = spark.range(8).select(F.col("id").cast("int").alias("idx"), F.chr(F.col("id") + 97).alias("char"))
    return sequences.ctc_decode(ctc_frames(spark, sf_dir), blank, line="id", dictionary=letters).withColumn("score", r6("score"))


@query(ctc_sql(0))
def ctc_text(spark, sf_dir):
    """Eight frames of eight classes, blank first."""
    return ctc(spark, sf_dir, 0)


@query(ctc_sql(7))
def ctc_plate(spark, sf_dir):
    """The same with the blank last."""
    return ctc(spark, sf_dir, 7)


@query("SELECT vec_id AS id, (list_position(embedding[1:32], list_max(embedding[1:32])) - 1) / 2.0::DOUBLE AS x, (list_position(embedding[33:64], list_max(embedding[33:64])) - 1) / 2.0::DOUBLE AS y, least(list_max(embedding[1:32]), list_max(embedding[33:64]))::DOUBLE AS score FROM embeddings")
def simcc_keypoints(spark, sf_dir):
    return fx.scores(spark, sf_dir).select("id", decode.simcc(F.slice("scores", 1, 32), F.slice("scores", 33, 32)).alias("k")).select("id", "k.*")


@query(f"WITH {fx.SQL_FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY seq_id) AS n FROM frames) SELECT seq_id, event_id, CAST(frame_no - 1 - greatest((n - 30) // 2, 0) AS INT) AS t FROM n WHERE frame_no - 1 - greatest((n - 30) // 2, 0) BETWEEN 0 AND 29")
def action_window(spark, sf_dir):
    return sequences.middle_frames(fx.frames(spark, sf_dir)).select("seq_id", "event_id", "t")


TOKEN = """CASE event_type WHEN 'view' THEN '<tr>' WHEN 'click' THEN '<td></td>' WHEN 'purchase' THEN '<td' WHEN 'signup' THEN ' colspan="2"' ELSE '>' END"""


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS id, {TOKEN} AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT id, 0::BIGINT AS n, '' AS html, false AS op, '' AS attrs, []::INT[] AS cells FROM (SELECT DISTINCT id FROM e)
UNION ALL SELECT s.id, e.n,
 CASE WHEN e.t = '<td' OR (op AND e.t LIKE ' colspan%') THEN html WHEN op AND e.t = '>' THEN html || '<td' || attrs || '>' ELSE html || e.t END,
 e.t = '<td' OR (op AND e.t <> '>'),
 CASE WHEN e.t = '<td' OR (op AND e.t = '>') THEN '' WHEN op AND e.t LIKE ' colspan%' THEN attrs || e.t ELSE attrs END,
 CASE WHEN e.t = '<tr>' THEN list_append(cells, 0) WHEN len(cells) > 0 AND (e.t = '<td></td>' OR (op AND e.t = '>')) THEN list_append(cells[1:len(cells) - 1], cells[len(cells)] + CASE WHEN e.t = '>' AND attrs <> '' THEN 2 ELSE 1 END) ELSE cells END
 FROM s JOIN e ON e.id = s.id AND e.n = s.n + 1)
SELECT id, '<html><body><table>' || html || '</table></body></html>' AS html, CAST(len(cells) AS INT) AS n_rows, CAST(coalesce(list_max(cells), 0) AS INT) AS n_cols FROM s QUALIFY n = max(n) OVER (PARTITION BY id)""")
def table_html(spark, sf_dir):
    tokens = fx.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.expr(TOKEN).alias("t")))).alias("a"))
    return tokens.select("id", sequences.table_html(F.transform("a", lambda s: s["t"])).alias("t")).select("id", "t.*")


@query("SELECT event_id, user_id % 16 AS queue_id, CAST(floor((row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) - 1) / 8) AS BIGINT) AS batch_no FROM events")
def count_batches(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 16).alias("queue_id"))
    return sequences.count_batches(rows, 8, order="event_id")


@query("""WITH RECURSIVE r AS (SELECT event_id, user_id, epoch_us(ts) / 1000.0::DOUBLE AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT user_id, n, event_id, 0 AS batch_no, 1 AS c, ms AS since FROM r WHERE n = 1
UNION ALL SELECT r.user_id, r.n, r.event_id, s.batch_no + CASE WHEN d THEN 1 ELSE 0 END, CASE WHEN d THEN 1 ELSE s.c + 1 END, CASE WHEN d THEN r.ms ELSE s.since END
FROM s JOIN r ON r.user_id = s.user_id AND r.n = s.n + 1, LATERAL (SELECT s.c >= 8 OR r.ms - s.since >= 3600000 AS d)) SELECT event_id, user_id, batch_no FROM s""")
def timed_batches(spark, sf_dir):
    """A user's events as requests; a batch closes at 8 or after an hour."""
    rows = fx.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return sequences.micro_batches(rows, 8, 3_600_000, queue="user_id", order="event_id").select("event_id", "user_id", "batch_no")


# ---- pixel planes


@query(f"WITH {fx.SQL_GRAY} SELECT img, v AS class_id, count(*) AS n FROM gray GROUP BY 1, 2")
def class_histogram(spark, sf_dir):
    return planes.class_histogram(fx.gray(spark, sf_dir), "img").drop("rank")


@query(f"WITH {fx.SQL_GRAY}, p AS (SELECT img, v // 64 AS c FROM gray) SELECT img, CAST(c AS INT) AS class_id, round(count(*) / 64.0::DOUBLE, 6) AS ratio FROM p WHERE c <> 0 GROUP BY 1, 2")
def part_ratios(spark, sf_dir):
    rows = fx.gray(spark, sf_dir).withColumn("v", F.floor(F.col("v") / 64).cast("int"))
    return planes.part_ratios(rows, "img").select("img", "class_id", r6("ratio").alias("ratio"))


@query(f"WITH {fx.SQL_GRAY} SELECT img, y, x, CASE WHEN v > 140 THEN 255 ELSE 0 END AS mask, CASE WHEN v > 140 THEN 0 ELSE 255 END AS inverse, CAST(least(255, greatest(0, round(v * 1.5::DOUBLE - 20.25::DOUBLE))) AS INT) AS scaled FROM gray")
def threshold_and_scale(spark, sf_dir):
    v = F.col("v")
    return fx.gray(spark, sf_dir).select("img", "y", "x", planes.threshold(v, 140).alias("mask"), planes.threshold(v, 140, inverse=True).alias("inverse"), planes.scale_and_shift(v, 1.5, -20.25).alias("scaled"))


@query(f"WITH {fx.SQL_GRAY}, b AS (SELECT img, min(x) FILTER (v > 150) AS x0, max(x) FILTER (v > 150) AS x1, min(y) FILTER (v > 150) AS y0, max(y) FILTER (v > 150) AS y1 FROM gray GROUP BY img) SELECT img, coalesce(x0, 0) AS x, coalesce(y0, 0) AS y, coalesce(x1 - x0 + 1, 0) AS width, coalesce(y1 - y0 + 1, 0) AS height FROM b")
def bounding_rect(spark, sf_dir):
    return planes.bounding_rect(fx.gray(spark, sf_dir), "img", 150)


@query(f"WITH {fx.SQL_GRAY} SELECT img, min(v) AS min_v, arg_min(x, v * 64 + y * 8 + x) AS min_x, arg_min(y, v * 64 + y * 8 + x) AS min_y, max(v) AS max_v, arg_min(x, -v * 64 + y * 8 + x) AS max_x, arg_min(y, -v * 64 + y * 8 + x) AS max_y FROM gray GROUP BY img")
def min_max_loc(spark, sf_dir):
    return planes.min_max_loc(fx.gray(spark, sf_dir), "img")




def near_sql(f: str) -> str:
    return f"WITH {fx.SQL_GRAY}, p AS (SELECT img, y, x, v FROM gray UNION ALL SELECT img, y, x, 0 FROM (SELECT DISTINCT img FROM gray), range(-1, 9) a(y), range(-1, 9) b(x) WHERE y IN (-1, 8) OR x IN (-1, 8)) SELECT g.img, g.y, g.x, {f}(p.v) AS v FROM gray g JOIN p ON p.img = g.img AND p.y BETWEEN g.y - 1 AND g.y + 1 AND p.x BETWEEN g.x - 1 AND g.x + 1 GROUP BY 1, 2, 3"


@query(near_sql("min"))
def erode(spark, sf_dir):
    return planes.morphology(fx.gray(spark, sf_dir), "erode", 3, "img")


@query(near_sql("max"))
def dilate(spark, sf_dir):
    return planes.morphology(fx.gray(spark, sf_dir), "dilate", 3, "img")


@query(f"WITH {fx.SQL_GRAY} SELECT img, y, x, round(CASE WHEN max(v) OVER w - min(v) OVER w > 1e-6 THEN (v - min(v) OVER w)::DOUBLE / (max(v) OVER w - min(v) OVER w) ELSE 0 END, 6) AS v FROM gray WINDOW w AS (PARTITION BY img)")
def depth_min_max(spark, sf_dir):
    return planes.min_max_normalize(fx.gray(spark, sf_dir), "img").withColumn("v", r6("v"))


NEAR = {(dx, dy): f"lag(v, {-(dx + 8 * dy)}) OVER w" if dx + 8 * dy < 0 else f"lead(v, {dx + 8 * dy}) OVER w" for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)}


@query(f"""WITH {fx.SQL_GRAY}, c AS (SELECT img, y, x, v, {NEAR[0, -1]} + {NEAR[0, 1]} + {NEAR[-1, 0]} + {NEAR[1, 0]} - 4 * v AS l, abs({NEAR[-1, -1]} - 2 * {NEAR[0, -1]} + {NEAR[1, -1]} - 2 * {NEAR[-1, 0]} + 4 * v - 2 * {NEAR[1, 0]} + {NEAR[-1, 1]} - 2 * {NEAR[0, 1]} + {NEAR[1, 1]}) AS m FROM gray WINDOW w AS (PARTITION BY img ORDER BY y, x)),
a AS (SELECT img, avg(l * l) FILTER (x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6) - avg(l) FILTER (x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6) ** 2 AS blur, avg(v) AS brightness, stddev_pop(v) AS contrast, sqrt(pi() / 2) * sum(m) FILTER (x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6) / 216 AS noise FROM c GROUP BY img)
SELECT img, round(blur, 6) AS blur, round(brightness, 6) AS brightness, round(contrast, 6) AS contrast, round(noise, 6) AS noise, round(0.4::DOUBLE * blur / (blur + 500) + 0.2::DOUBLE * (1 - abs(brightness - 127.5) / 127.5) + 0.25::DOUBLE * least(1, contrast / 50) + 0.15::DOUBLE * greatest(0, 1 - noise / 15), 6) AS overall FROM a""")
def image_quality(spark, sf_dir):
    return planes.image_quality(fx.gray_arrays(spark, sf_dir)).select("img", *[r6(c).alias(c) for c in ("blur", "brightness", "contrast", "noise", "overall")])


@query(f"""WITH {fx.SQL_GRAY}, p AS MATERIALIZED (SELECT img, list(v ORDER BY y, x) AS vs FROM gray GROUP BY img), two AS (SELECT a.img, a.vs, b.vs AS us FROM p a JOIN p b ON b.img = a.img + 1)
SELECT img, CAST(i - 1 AS INT) AS i, greatest(vs[i], us[i]) AS v FROM two, range(1, 65) t(i)""")
def mask_unions(spark, sf_dir):
    rows = fx.gray_arrays(spark, sf_dir).select("img", "data")
    other = rows.select((F.col("img") - 1).alias("img"), F.col("data").alias("other"))
    return rows.join(other, "img").select("img", F.posexplode(planes.mask_union(F.col("data"), F.col("other"))).alias("i", "v"))


@query("SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / 64, 7) AS mean, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / 64 < 0.01::DOUBLE AS live, CAST(len(list_filter(embedding, lambda x: x::DOUBLE > 0.1::DOUBLE)) AS INT) AS area FROM embeddings")
def map_means(spark, sf_dir):
    mean = vectors.total(F.col("scores")) / F.size("scores")
    return fx.scores(spark, sf_dir).select("id", F.round(mean, 7).alias("mean"), (mean < 0.01).alias("live"), planes.mask_area(F.col("scores"), 0.1).alias("area"))


@query(f"""WITH RECURSIVE {fx.SQL_GRAY}, lit AS MATERIALIZED (SELECT img, y, x, v FROM gray WHERE v > 140),
reach AS (SELECT img, y * 8 + x AS origin, y, x FROM lit
UNION SELECT r.img, r.origin, l.y, l.x FROM reach r JOIN lit l ON l.img = r.img AND abs(l.y - r.y) <= 1 AND abs(l.x - r.x) <= 1),
homes AS (SELECT img, y, x, min(origin) AS home FROM reach GROUP BY img, y, x),
sums AS (SELECT img, home, count(*) AS n, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, avg(v) AS m, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM homes JOIN lit USING (img, y, x) GROUP BY img, home)
SELECT img, CAST(row_number() OVER (PARTITION BY img ORDER BY home) - 1 AS INT) AS component, CAST(n AS INT) AS area, x1, y1, x2, y2, round(m, 6) AS mean, round(0.5::DOUBLE * atan2(2 * (n * sxy - sx * sy)::DOUBLE, ((n * sxx - sx * sx) - (n * syy - sy * sy))::DOUBLE), 6) AS angle FROM sums""")
def connected_components(spark, sf_dir):
    """Regions of pixels above 140; the SQL follows neighbours from each pixel."""
    found = planes.components(fx.gray(spark, sf_dir), 140, "img")
    return found.withColumn("mean", r6("mean")).withColumn("angle", r6("angle"))


# ---- rules

KEYPOINTS = "(SELECT vec_id AS id, list_transform(range(0, {n}), lambda i: struct_pack(x := embedding[i * 3 + 1]::DOUBLE, y := embedding[i * 3 + 2]::DOUBLE, s := least(1, abs(embedding[i * 3 + 3]::DOUBLE) * 4))) AS k FROM embeddings)"


def keypoints(spark, sf_dir, n: int) -> DataFrame:
    at = lambda i, j: F.element_at("scores", i * 3 + j)
    kps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(at(i, 1).alias("x"), at(i, 2).alias("y"), F.least(F.lit(1.0), F.abs(at(i, 3)) * 4).alias("score")))
    return fx.scores(spark, sf_dir).select("id", kps.alias("k"))


def middle_sql(a: int, b: int, c: str) -> str:
    return f"CASE WHEN k[{a + 1}].s >= 0.3 AND k[{b + 1}].s >= 0.3 THEN (k[{a + 1}].{c} + k[{b + 1}].{c}) / 2 WHEN k[{a + 1}].s >= 0.3 THEN k[{a + 1}].{c} WHEN k[{b + 1}].s >= 0.3 THEN k[{b + 1}].{c} END"


@query(f"""WITH k AS {KEYPOINTS.format(n=17)}, d AS (SELECT id, k, {middle_sql(11, 12, 'x')} - ({middle_sql(5, 6, 'x')}) AS dx, {middle_sql(11, 12, 'y')} - ({middle_sql(5, 6, 'y')}) AS dy FROM k), a AS (SELECT id, k, CASE WHEN sqrt(dx * dx + dy * dy) >= 1e-6 THEN degrees(acos(least(1, abs(dy) / sqrt(dx * dx + dy * dy)))) END AS a FROM d)
SELECT id, round(a, 6) AS angle, coalesce(a > 60 AND 90 - a <= 30, false) AS lying, CASE WHEN a IS NULL OR a <= 30 THEN 'Upright' WHEN a >= 60 THEN 'Lying' ELSE 'Tilted' END AS orientation,
(k[10].s >= 0.3 AND k[6].s >= 0.3 AND k[10].y < k[6].y) OR (k[11].s >= 0.3 AND k[7].s >= 0.3 AND k[11].y < k[7].y) AS hands_up FROM a""")
def pose_rules(spark, sf_dir):
    k = F.col("k")
    return keypoints(spark, sf_dir, 17).select("id", r6(rules.torso_angle(k)).alias("angle"), rules.is_lying(k).alias("lying"), rules.body_orientation(k).alias("orientation"), rules.is_hands_up(k).alias("hands_up"))


def ext_sql(i: int) -> str:
    far = lambda a, b: f"sqrt((k[{a + 1}].x - k[{b + 1}].x) ** 2 + (k[{a + 1}].y - k[{b + 1}].y) ** 2)"
    unit = lambda x, lo, hi: f"greatest(0, least(1, ({x} - {lo}::DOUBLE) / ({hi}::DOUBLE - {lo}::DOUBLE)))"
    if i == 0:
        return unit(f"greatest({far(4, 17)} / greatest({far(3, 17)}, 1e-6), {far(4, 0)} / greatest({far(2, 0)}, 1e-6))", 1.15, 1.5)
    tip = 4 + 4 * i
    return unit(f"{far(tip, 0)} / greatest({far(tip - 2, 0)}, 1e-6)", 1.0, 1.35)


def hits_sql() -> str:
    out = []
    for n, (label, pattern) in enumerate(rules.GESTURES):
        hit = "(" + " + ".join(f"e{i}" if on else f"(1 - e{i})" for i, on in enumerate(pattern)) + ") / 5"
        if label.startswith("Thumb"):
            hit += f" * greatest(0, least(1, ({'' if label == 'Thumb_Up' else '-'}up - 0.2::DOUBLE) / 0.7::DOUBLE))"
        out.append(f"SELECT id, {-n} AS o, '{label}' AS label, {hit} AS score FROM e")
    return " UNION ALL ".join(out)


@query(f"""WITH k AS {KEYPOINTS.format(n=21)}, e AS (SELECT id, {', '.join(f'{ext_sql(i)} AS e{i}' for i in range(5))}, (k[4].y - k[5].y) / greatest(sqrt((k[4].x - k[5].x) ** 2 + (k[4].y - k[5].y) ** 2), 1e-6) AS up FROM k), h AS ({hits_sql()}), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, o DESC) AS r FROM h)
SELECT id, CASE WHEN score >= 0.55 THEN label ELSE 'Unknown' END AS label, round(score, 6) AS score FROM b WHERE r = 1""")
def gesture_rules(spark, sf_dir):
    return keypoints(spark, sf_dir, 21).select("id", rules.gesture(F.col("k")).alias("g")).select("id", "g.label", r6("g.score").alias("score"))


@query("""WITH m AS (SELECT o_orderkey AS id, (o_custkey * 7 % 256)::DOUBLE AS b, (o_orderkey * 13 % 256)::DOUBLE AS g, (o_custkey * 31 % 256)::DOUBLE AS r FROM orders)
SELECT id, CASE WHEN g >= b + 15 AND g >= r + 15 THEN 'green' WHEN b >= r + 15 AND b >= g + 10 THEN 'blue' WHEN r >= b + 30 AND g >= b + 20 THEN 'yellow' WHEN greatest(b, g, r) - least(b, g, r) < 30 AND (b + g + r) / 3 < 70 THEN 'black' WHEN greatest(b, g, r) - least(b, g, r) < 30 THEN 'white' ELSE 'unknown' END AS colour FROM m""")
def plate_colours(spark, sf_dir):
    means = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CAST(o_custkey * 7 % 256 AS DOUBLE) AS b", "CAST(o_orderkey * 13 % 256 AS DOUBLE) AS g", "CAST(o_custkey * 31 % 256 AS DOUBLE) AS r")
    return means.select("id", rules.plate_colour(F.col("b"), F.col("g"), F.col("r")).alias("colour"))


# ---- whole images and scoring


def plane_sql(columns: str, rest: str = "") -> str:
    return f"WITH {fx.SQL_GRAY} SELECT {columns} FROM gray {rest}"


@query(plane_sql("img AS image_id, y // 2 AS y, x // 2 AS x, 0 AS channel, CAST(floor(avg(v) + 0.5) AS INT) AS v", "GROUP BY 1, 2, 3"))
def resize_area(spark, sf_dir):
    """Images at half their size, each pixel the mean of four."""
    return tables.pixels(raster.map_images(fx.images(spark, sf_dir), lambda a: raster.resize(a, 4, 4, "area")))


@query(plane_sql("img AS image_id, y, x, c AS channel, v", ", range(0, 3) t(c)"))
def gray_to_bgr(spark, sf_dir):
    return tables.pixels(raster.map_images(fx.images(spark, sf_dir), lambda a: raster.convert_colour(a, "gray2bgr")))


@query(plane_sql("img AS image_id, y + 1 AS y, x + 2 AS x, v", "") + " UNION ALL SELECT vec_id, y, x, 114 FROM embeddings, range(0, 10) a(y), range(0, 12) b(x) WHERE NOT (y BETWEEN 1 AND 8 AND x BETWEEN 2 AND 9)")
def constant_border(spark, sf_dir):
    return tables.pixels(raster.map_images(fx.images(spark, sf_dir), lambda a: raster.border(a, 1, 1, 2, 2, 114))).drop("channel")


@query(plane_sql("img AS parent, y - img % 3 AS y, x - img % 4 AS x, v", "WHERE y BETWEEN img % 3 AND img % 3 + 3 AND x BETWEEN img % 4 AND img % 4 + 2"))
def box_crops(spark, sf_dir):
    """The pixels of one box of each image, as a cascade's second model gets them."""
    rows = fx.images(spark, sf_dir)
    boxes = rows.selectExpr("image_id", "1L AS det_id", "CAST(image_id % 4 AS DOUBLE) AS x1", "CAST(image_id % 3 AS DOUBLE) AS y1", "CAST(image_id % 4 + 3 AS DOUBLE) AS x2", "CAST(image_id % 3 + 4 AS DOUBLE) AS y2")
    parts = pipelines.crops(rows, boxes)
    return tables.pixels(parts).join(parts.select("image_id", "parent"), "image_id").select("parent", "y", "x", "v")


@query(plane_sql("img AS id, CAST(count(*) AS INT) AS area, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2", "WHERE v > 150 GROUP BY 1"))
def mask_boxes(spark, sf_dir):
    mask = F.struct("width", "height", F.transform("data", lambda v: v.cast("float")).alias("data"))
    rows = fx.gray_arrays(spark, sf_dir).select(F.col("img").alias("id"), mask.alias("m"))
    return rows.select("id", masks.area(F.col("m"), 150.0).alias("area"), masks.box(F.col("m"), 150.0).alias("b")).where("b is not null").select("id", "area", "b.*")


@query("SELECT vec_id AS id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS class_id FROM embeddings")
def scored_top1(spark, sf_dir):
    """A model of one softmax, run in the workers, and its best class."""
    rows = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    scored = scoring.output(scoring.score_vectors(rows, scoring.onnx_scorer(scoring.micro_model("Softmax", 64, axis=1)), "embedding", "id"))
    return scored.select(F.col("image_id").alias("id"), vectors.argmax(F.col("f32")).alias("class_id"))
