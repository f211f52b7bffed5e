"""Model outputs to rows: one row per anchor or query, with its best class, filtered and in image coordinates.

Inputs are tables with one row per image and the raw output as arrays.  posexplode makes a row per anchor,
so a later filter, rank or suppression is a plain DataFrame step and confidence filters run before any
costly projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, vectors

#: fixed values: how each engine compares a confidence with its threshold, and the default
THRESHOLDS: dict[str, tuple[str, float]] = {
    "classification": (">=", 0.5),
    "detection": (">=", 0.5),
    "transformer": (">", 0.5),
    "segmentation": (">=", 0.5),
    "open_vocabulary": (">", 0.01),
    "pose": (">=", 0.25),
    "pose_one_stage": (">=", 0.45),
    "rotated": (">=", 0.5),
    "face": (">=", 0.6),
    "qr": (">", 0.2),
    "plate": (">=", 0.5),
    "palm": (">=", 0.5),
    "concepts": (">=", 0.1),
    "feature_matches": (">", 0.0),
    "mutual_matches": (">=", 0.1),
    "dense_matches": (">=", 0.3),
    "keypoint_features": (">=", 0.0),
}


def passes(score: Column, engine: str, threshold: float | None = None) -> Column:
    """The engine's confidence filter."""
    how, default = THRESHOLDS[engine]
    limit = F.lit(default if threshold is None else threshold)
    return score >= limit if how == ">=" else score > limit


def anchors(outputs: DataFrame, values: str, channels: int, channel_major: bool = True, image: str = "image_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """image, anchor, v (the anchor's channels) from a flat [channels, anchors] or [anchors, channels] output."""
    n = (F.size(values) / channels).cast("int")
    pick = (lambda a: F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.element_at(values, c * n + a + 1))) if channel_major else (lambda a: F.slice(values, a * channels + 1, F.lit(channels)))
    rows = F.transform(F.sequence(F.lit(0), n - 1), pick)
    return outputs.where(F.size(values) >= channels).select(image, *keep, F.posexplode(rows).alias("anchor", "v"))


def best_class(df: DataFrame, scores: Column, first_positive: bool = True) -> DataFrame:
    """Adds class_id (the first largest; -1 if first_positive and none is above 0) and score."""
    pick = vectors.argmax_positive(scores) if first_positive else vectors.argmax(scores)
    return df.withColumn("class_id", pick).withColumn("score", F.greatest(F.array_max(scores).cast("double"), F.lit(0.0)) if first_positive else F.array_max(scores).cast("double"))


def decode_centre_boxes(rows: DataFrame, classes: int, engine: str = "detection", threshold: float | None = None) -> DataFrame:
    """From v = cx, cy, w, h and class scores (then anything else): class_id, score and x1..y2 in input coordinates."""
    scored = best_class(rows, F.slice("v", 5, classes)).where((F.col("class_id") >= 0) & passes(F.col("score"), engine, threshold))
    v = lambda i: F.col("v")[i].cast("double")
    return scored.withColumn("box", geometry.from_centre(v(0), v(1), v(2), v(3))).select(*[c for c in scored.columns], "box.*")


def decode_end_to_end(rows: DataFrame, engine: str = "detection", threshold: float | None = None) -> DataFrame:
    """From v = x1, y1, x2, y2, score, class (then anything else)."""
    v = lambda i: F.col("v")[i].cast("double")
    out = rows.select("*", *[v(i).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2", "score"))], F.round(v(5)).cast("int").alias("class_id"))
    return out.where(passes(F.col("score"), engine, threshold))


def decode_queries(rows: DataFrame, width: Column, height: Column, threshold: float | None = None, most: int = 300, image: str = "image_id") -> DataFrame:
    """Transformer queries v = cx, cy, w, h (shares of the image) and class scores, which get a sigmoid if they need one.

    The `most` best of each image above the threshold, in its pixels and clipped to it.
    """
    sure = rows.withColumn("scores", vectors.sigmoid_if_needed(F.slice("v", 5, F.size("v") - 4)))
    scored = best_class(sure, F.col("scores")).where((F.col("class_id") >= 0) & passes(F.col("score"), "transformer", threshold))
    place = F.row_number().over(Window.partitionBy(image).orderBy(F.desc("score"), "anchor"))
    top = scored.withColumn("place", place).where(F.col("place") <= most)
    v = lambda i: F.col("v")[i].cast("double")
    x1, y1, x2, y2 = geometry.side(geometry.from_centre(v(0) * width, v(1) * height, v(2) * width, v(3) * height))
    box = geometry.clip(F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")), width, height)
    return top.withColumn("box", box).drop("scores", "v").select(*[c for c in top.columns if c not in ("scores", "v")], "box.*")


def top_queries(queries: DataFrame, k: int = 1, threshold: float = 0.1, image: str = "image_id") -> DataFrame:
    """The k surest queries (score, query) of each image and class that reach the threshold, of equals the first."""
    place = F.row_number().over(Window.partitionBy(image, "class_id").orderBy(F.desc("score"), "query"))
    return queries.where(passes(F.col("score"), "concepts", threshold)).withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def decode_rotated(rows: DataFrame, classes: int, threshold: float | None = None) -> DataFrame:
    """From v = cx, cy, w, h, class scores, angle."""
    scored = best_class(rows, F.slice("v", 5, classes), first_positive=False).where(passes(F.col("score"), "rotated", threshold))
    v = lambda i: F.col("v")[i].cast("double")
    return scored.select("*", *[v(i).alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))], v(4 + classes).alias("angle"))


def decode_rotated_end_to_end(rows: DataFrame, threshold: float | None = None) -> DataFrame:
    """From v = cx, cy, w, h, score, class, angle."""
    v = lambda i: F.col("v")[i].cast("double")
    out = rows.select("*", *[v(i).alias(c) for i, c in enumerate(("cx", "cy", "w", "h", "score"))], F.round(v(5)).cast("int").alias("class_id"), v(6).alias("angle"))
    return out.where(passes(F.col("score"), "rotated", threshold))


def decode_face_score(cls: Column, obj: Column) -> Column:
    """sqrt of class and object score, each within 0 and 1."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double")))
    return F.sqrt(unit(cls) * unit(obj))


def decode_ssd(offsets: DataFrame, priors: DataFrame, image: str = "image_id") -> DataFrame:
    """Rows (prior_idx, o = four offsets, score) joined to their priors and decoded to x1..y2, shares of the input.

    The priors are a fixed table of thousands of rows.
    """
    joined = offsets.join(F.broadcast(priors), "prior_idx")
    prior = F.struct("cx", "cy", "w", "h")
    return joined.withColumn("box", geometry.ssd_box(prior, F.col("o"))).select(*offsets.columns, "box.*")


def keypoints_from(v: Column, start: int, count: int) -> Column:
    """Keypoints from triples x, y, score; scores outside 0..1 get a sigmoid."""
    raw = lambda i: F.element_at(v, F.lit(start + 1) + i * 3 + 2).cast("double")
    at = lambda i, j: F.element_at(v, F.lit(start + 1) + i * 3 + j).cast("float")
    score = lambda i: F.when((raw(i) < 0) | (raw(i) > 1), vectors.sigmoid(raw(i))).otherwise(raw(i)).cast("float")
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.struct(at(i, 0).alias("x"), at(i, 1).alias("y"), score(i).alias("score")))


def simcc(x_bins: Column, y_bins: Column, split: float = 2.0) -> Column:
    """A keypoint from its two axes: first largest bin over `split`, the smaller of both maxima as score."""
    return F.struct(
        (vectors.argmax(x_bins) / split).cast("double").alias("x"),
        (vectors.argmax(y_bins) / split).cast("double").alias("y"),
        F.least(F.array_max(x_bins), F.array_max(y_bins)).cast("double").alias("score"),
    )


def token_phrases(queries: DataFrame, box_threshold: float = 0.25, text_threshold: float = 0.2, pad: str = "[PAD]", stops: tuple[str, ...] = (".", "[CLS]", "[SEP]", "[PAD]")) -> DataFrame:
    """Grounded queries (logits over tokens, tokens): best token but the last, its phrase and sigmoid score; those below the thresholds, on padding or without words go."""
    from ..functions.text import phrase_around

    usable = F.slice("logits", 1, F.size("logits") - 1)
    scored = queries.withColumn("token", vectors.argmax(usable)).withColumn("score", vectors.sigmoid(F.array_max(usable)))
    scored = scored.where((F.col("score") >= box_threshold) & (F.col("score") >= text_threshold)).where(F.get("tokens", F.col("token")) != pad)
    return scored.withColumn("phrase", F.trim(phrase_around(F.col("tokens"), F.col("token"), list(stops)))).where("phrase <> ''")


def from_scores(scores: DataFrame, k: int, threshold: float | None = None, values: str = "scores", image: str = "image_id") -> DataFrame:
    """The k best classes of each image: rank, class_id, score; with a threshold only images whose best reaches it."""
    rows = scores if threshold is None else scores.where(passes(F.array_max(values), "classification", threshold))
    return rows.select(image, F.posexplode(vectors.top_k(F.col(values), k)).alias("rank", "t")).select(image, (F.col("rank") + 1).alias("rank"), "t.class_id", "t.score")


def with_labels(rows: DataFrame, labels: DataFrame, limit: int = 100_000) -> DataFrame:
    """class_name by class_id; a class without a label is named by its number.  Labels are broadcast if there are `limit` at most."""
    from ..functions.text import label_name

    small = labels.select(F.col("class_id"), F.col("name").alias("_name"))
    small = F.broadcast(small) if labels.limit(limit + 1).count() <= limit else small
    return rows.join(small, "class_id", "left").withColumn("class_name", label_name(F.col("_name"), F.col("class_id"))).drop("_name")
