"""Rules over keypoints and colours as column expressions.

Keypoints are arrays of structs x, y, score, in the orders of the usual 17 (body) and 21
hand points (wrist, then four for each finger from the thumb).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import ramp


def point(keypoints: Column, index: int, least: float | None = None) -> Column:
    """The keypoint, or null if it is missing or its score is below `least`."""
    p = F.get(keypoints, F.lit(index))
    return p if least is None else F.when(p["score"] >= least, p)


def middle(a: Column, b: Column) -> Column:
    """The point between two, or the one that isn't null."""
    mid = lambda c: F.when(a.isNotNull() & b.isNotNull(), (a[c].cast("double") + b[c].cast("double")) / 2).otherwise(F.coalesce(a[c], b[c]).cast("double"))
    return F.when(a.isNotNull() | b.isNotNull(), F.struct(mid("x").alias("x"), mid("y").alias("y")))


def torso_angle(keypoints: Column, least: float = 0.3) -> Column:
    """Degrees between the vertical and the line from shoulders to hips; null if either end is unknown."""
    top = middle(point(keypoints, 5, least), point(keypoints, 6, least))
    end = middle(point(keypoints, 11, least), point(keypoints, 12, least))
    dx, dy = end["x"] - top["x"], end["y"] - top["y"]
    length = F.sqrt(dx * dx + dy * dy)
    return F.when(length >= 1e-6, F.degrees(F.acos(F.least(F.abs(dy) / F.when(length >= 1e-6, length), F.lit(1.0)))))


def is_lying(keypoints: Column, lying: float = 60.0, horizontal: float = 30.0, least: float = 0.3) -> Column:
    angle = torso_angle(keypoints, least)
    return F.coalesce((angle > lying) & (90 - angle <= horizontal), F.lit(False))


def is_hands_up(keypoints: Column, margin: float = 0.0, least: float = 0.3) -> Column:
    """Whether a wrist is above its shoulder by more than the margin."""
    raised = [point(keypoints, wrist, least)["y"] < point(keypoints, shoulder, least)["y"] - F.lit(margin) for wrist, shoulder in ((9, 5), (10, 6))]
    return F.coalesce(raised[0], F.lit(False)) | F.coalesce(raised[1], F.lit(False))


def body_orientation(keypoints: Column, upright: float = 30.0, lying: float = 60.0, least: float = 0.3) -> Column:
    """Upright (also if the torso is unknown), Lying or Tilted."""
    angle = torso_angle(keypoints, least)
    return F.when(angle.isNull() | (angle <= upright), "Upright").when(angle >= lying, "Lying").otherwise("Tilted")


def distance(a: Column, b: Column) -> Column:
    dx, dy = a["x"].cast("double") - b["x"].cast("double"), a["y"].cast("double") - b["y"].cast("double")
    return F.sqrt(dx * dx + dy * dy)


#: fixed values: gestures and which of thumb, index, middle, ring and little finger are stretched
GESTURES = (
    ("Fist", (0, 0, 0, 0, 0)),
    ("Open_Palm", (1, 1, 1, 1, 1)),
    ("Victory", (0, 1, 1, 0, 0)),
    ("Pointing_Up", (0, 1, 0, 0, 0)),
    ("Thumb_Up", (1, 0, 0, 0, 0)),
    ("Thumb_Down", (1, 0, 0, 0, 0)),
    ("Three", (0, 1, 1, 1, 0)),
    ("Three", (1, 1, 1, 0, 0)),
    ("Four", (0, 1, 1, 1, 1)),
)


def finger_extensions(keypoints: Column) -> list[Column]:
    """How far each finger is stretched, 0 to 1."""
    p = lambda i: point(keypoints, i)
    to = lambda i, j: distance(p(i), p(j))
    least = F.lit(1e-6)
    thumb = F.greatest(to(4, 17) / F.greatest(to(3, 17), least), to(4, 0) / F.greatest(to(2, 0), least))
    fingers = [ramp(to(tip, 0) / F.greatest(to(tip - 2, 0), least), 1.0, 1.35) for tip in (8, 12, 16, 20)]
    return [ramp(thumb, 1.15, 1.5), *fingers]


def gesture(keypoints: Column, least_hit: float = 0.55) -> Column:
    """label and score of the best pattern, Unknown below least_hit; needs 21 points.

    Of equals the first: scores that agree to nine decimals are equal, as sums of the same parts differ in their last bits.
    """
    p = lambda i: point(keypoints, i)
    upward = (p(3)["y"].cast("double") - p(4)["y"].cast("double")) / F.greatest(distance(p(3), p(4)), F.lit(1e-6))

    def best_of(s: Column) -> Column:
        hits = []
        for order, (label, pattern) in enumerate(GESTURES):
            hit = sum((s[f"e{i}"] if on else 1 - s[f"e{i}"] for i, on in enumerate(pattern)), F.lit(0.0)) / 5
            if label.startswith("Thumb"):
                hit = hit * ramp(s["up"] if label == "Thumb_Up" else -s["up"], 0.2, 0.9)
            hits.append(F.struct(F.round(hit, 9).alias("rounded"), F.lit(-order).alias("order"), hit.alias("score"), F.lit(label).alias("label")))
        return F.greatest(*hits)

    # one-element arrays bind what is used often, so that it is computed, and compiled, once
    measures = F.struct(*[e.alias(f"e{i}") for i, e in enumerate(finger_extensions(keypoints))], upward.alias("up"))
    found = F.transform(
        F.transform(F.array(measures), best_of),
        lambda best: F.struct(F.when(best["score"] >= least_hit, best["label"]).otherwise("Unknown").alias("label"), best["score"].alias("score")),
    )[0]
    return F.when(F.size(keypoints) == 21, found).otherwise(F.raise_error(F.lit("a gesture needs 21 keypoints")).cast("struct<label:string,score:double>"))


def plate_colour(b: Column, g: Column, r: Column) -> Column:
    """Colour of a number plate from the means of its channels: green, blue, yellow, black, white or unknown."""
    spread = F.greatest(b, g, r) - F.least(b, g, r)
    return (
        F.when((g >= b + 15) & (g >= r + 15), "green")
        .when((b >= r + 15) & (b >= g + 10), "blue")
        .when((r >= b + 30) & (g >= b + 20), "yellow")
        .when((spread < 30) & ((b + g + r) / 3 < 70), "black")
        .when(spread < 30, "white")
        .otherwise("unknown")
    )


def similarity_transform(source: list[tuple[float, float]], target: list[tuple[float, float]]) -> tuple[float, float, float, float]:
    """Least-squares a, b, tx, ty of (ax - by + tx, bx + ay + ty) that takes source points to target points."""
    n = len(source)
    sx, sy, tx, ty = (sum(p[i] for p in points) / n for points in (source, target) for i in (0, 1))
    even = odd = square = 0.0
    for (x, y), (u, v) in zip(source, target):
        x, y, u, v = x - sx, y - sy, u - tx, v - ty
        even, odd, square = even + x * u + y * v, odd + x * v - y * u, square + x * x + y * y
    if math.isclose(square, 0.0):
        raise ValueError("the points coincide")
    a, b = even / square, odd / square
    return a, b, tx - a * sx + b * sy, ty - b * sx - a * sy
