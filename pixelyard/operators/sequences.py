"""Sequences: CTC text, table structure, skeleton windows, micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import attribute_span

#: fixed values: tokens of the table structure model, without its start and end
SPANS = tuple(f' {kind}="{n}"' for kind in ("colspan", "rowspan") for n in range(2, 21))
STRUCTURE_TOKENS = ("<thead>", "</thead>", "<tbody>", "</tbody>", "<tr>", "</tr>", "<td", ">", "</td>", *SPANS, "<td></td>")


def ctc_decode(frames: DataFrame, blank: int, line: str = "line_id", at: str = "t", best: str = "best", prob: str = "prob", dictionary: DataFrame | None = None) -> DataFrame:
    """text (or classes, without a dictionary of idx and char) and score of each line.

    A frame is dropped if it is blank or repeats the one before; score is the mean probability of those
    kept.  A class beyond the dictionary has no character but counts in the score.  Lines without any kept
    frame have an empty text and score 0.
    """
    before = F.lag(best, 1, blank).over(Window.partitionBy(line).orderBy(at))
    kept = frames.withColumn("_emit", (F.col(best) != blank) & (F.col(best) != before))
    if dictionary is not None:
        kept = kept.join(F.broadcast(dictionary.select(F.col("idx").alias(best), "char")), best, "left")
    else:
        kept = kept.withColumn("char", F.col(best).cast("string"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("_emit"), F.struct(F.col(at).alias("t"), F.col("char").alias("c")))))
    text = F.array_join(F.transform(F.filter(ordered, lambda s: s["c"].isNotNull()), lambda s: s["c"]), "" if dictionary is not None else ",")
    return kept.groupBy(line).agg(text.alias("text"), F.coalesce(F.avg(F.when(F.col("_emit"), F.col(prob).cast("double"))), F.lit(0.0)).alias("score"), F.count_if("_emit").alias("emitted"))


def table_html(tokens: Column) -> Column:
    """html, n_rows and n_cols of a sequence of structure tokens.

    '<td' opens a cell whose attributes follow until '>'; other tokens stand as they are.  A cell counts for
    its colspan; n_cols is the longest row's.
    """
    state = F.struct(F.lit("").alias("html"), F.lit(False).alias("open"), F.lit("").alias("attrs"), F.array().cast("array<int>").alias("cells"))
    added = lambda cells, n: F.when(F.size(cells) > 0, F.concat(F.slice(cells, 1, F.size(cells) - 1), F.array(F.element_at(cells, -1) + n))).otherwise(cells)

    def step(s: Column, t: Column) -> Column:
        opens, closes = t == "<td", (t == ">") & s["open"]
        attribute = s["open"] & (t.startswith(" colspan=") | t.startswith(" rowspan="))
        html = F.when(opens | attribute, s["html"]).when(closes, F.concat(s["html"], F.lit("<td"), s["attrs"], F.lit(">"))).otherwise(F.concat(s["html"], t))
        cells = (
            F.when(closes, added(s["cells"], F.coalesce(attribute_span(s["attrs"], "colspan"), F.lit(1))))
            .when(t == "<td></td>", added(s["cells"], F.lit(1)))
            .when(t == "<tr>", F.concat(s["cells"], F.array(F.lit(0))))
            .otherwise(s["cells"])
        )
        attrs = F.when(opens | closes, "").when(attribute, F.concat(s["attrs"], t)).otherwise(s["attrs"])
        return F.struct(html.alias("html"), (opens | (s["open"] & ~closes)).alias("open"), attrs.alias("attrs"), cells.alias("cells"))

    def finish(s: Column) -> Column:
        return F.struct(F.concat(F.lit("<html><body><table>"), s["html"], F.lit("</table></body></html>")).alias("html"), F.size(s["cells"]).alias("n_rows"), F.coalesce(F.array_max(s["cells"]), F.lit(0)).alias("n_cols"))

    return F.aggregate(tokens, state, step, finish)


def structure_tokens(classes: Column, tokens: tuple[str, ...] = STRUCTURE_TOKENS) -> Column:
    """Tokens of a class sequence: class 0 starts, the last class ends the sequence unless it comes first; both and unknown classes are left out."""
    last = len(tokens) + 1
    end = F.array_position(F.slice(classes, 2, F.greatest(F.size(classes) - 1, F.lit(0))), last)
    body = F.when(end > 0, F.slice(classes, 1, end.cast("int"))).otherwise(classes)
    return F.transform(F.filter(body, lambda c: (c > 0) & (c < last)), lambda c: F.element_at(F.array(*map(F.lit, tokens)), c.cast("int")))


def cell_boxes(points: Column, width: Column, height: Column) -> Column:
    """The upright box of a cell's four corners (eight shares of the canvas); null where all are 0."""
    scale = F.greatest(width, height, F.lit(1)).cast("double")
    xs, ys = (F.transform(F.array(*range_of(points, k)), lambda v: v * scale) for k in (0, 1))
    box = F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))
    return F.when(F.exists(points, lambda v: v != 0), box)


def range_of(points: Column, start: int) -> list[Column]:
    return [points[i].cast("double") for i in range(start, 8, 2)]


def middle_frames(frames: DataFrame, most: int = 30, sequence: str = "seq_id", at: str = "frame_no") -> DataFrame:
    """The middle `most` frames of each sequence, numbered by t from 0; shorter sequences stay whole."""
    n = F.count(F.lit(1)).over(Window.partitionBy(sequence))
    row = F.row_number().over(Window.partitionBy(sequence).orderBy(at)) - 1
    start = F.greatest(F.floor((F.col("_n") - most) / 2), F.lit(0))
    numbered = frames.withColumn("_n", n).withColumn("_row", row)
    return numbered.withColumn("t", (F.col("_row") - start).cast("int")).where((F.col("t") >= 0) & (F.col("t") < most)).drop("_n", "_row")


#: fixed values: body keypoint of each of the 18 skeleton joints; joint 1, the neck, is between both shoulders
JOINTS = (0, None, 6, 8, 10, 5, 7, 9, 12, 14, 16, 11, 13, 15, 2, 1, 4, 3)


def skeleton_window(frames: DataFrame, most: int = 30, span: float = 0.6, sequence: str = "seq_id", at: str = "frame_no", keypoints: str = "keypoints") -> DataFrame:
    """Per sequence and t: 18 joints (x, y, score), centred on the window's valid points and scaled to `span`, y upwards; invalid joints are 0."""
    window = middle_frames(frames, most, sequence, at)
    valid = window.select(sequence, F.explode(keypoints).alias("p")).where("p.score > 0").groupBy(sequence)
    hull = valid.agg(F.min("p.x").alias("x1"), F.max("p.x").alias("x2"), F.min("p.y").alias("y1"), F.max("p.y").alias("y2"))
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(1e-6))
    scaled = window.join(hull, sequence, "left").withColumn("scale", span / side)
    p = lambda i: F.get(keypoints, F.lit(i))
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("score"))

    def joint(i: int | None) -> Column:
        if i is None:
            a, b = p(5), p(6)
            x, y, score = (a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2, F.least(a["score"], b["score"])
        else:
            x, y, score = p(i)["x"], p(i)["y"], p(i)["score"]
        moved = F.struct(
            ((x - (F.col("x1") + F.col("x2")) / 2) * F.col("scale")).cast("double").alias("x"),
            (-(y - (F.col("y1") + F.col("y2")) / 2) * F.col("scale")).cast("double").alias("y"),
            score.cast("double").alias("score"),
        )
        return F.when(F.coalesce(score > 0, F.lit(False)), moved).otherwise(zero)

    return scaled.select(sequence, "t", F.array(*map(joint, JOINTS)).alias("joints"))


def micro_batches(requests: DataFrame, most: int = 8, timeout_ms: int = 50, queue: str = "queue_id", ts: str = "ts", order: str = "request_id") -> DataFrame:
    """Adds batch_no: a batch closes at `most` requests, or when its next request comes timeout_ms after its first.

    The fold over a queue's requests is sequential by nature: one array a queue.
    """
    stamp = (F.unix_micros(F.col(ts).cast("timestamp")) / 1000).cast("double")
    packed = requests.groupBy(F.col(queue).alias("_queue")).agg(F.array_sort(F.collect_list(F.struct(stamp.alias("ms"), F.col(order).alias("o"), F.struct(*requests.columns).alias("row")))).alias("a"))
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("since"), F.lit(-1).alias("batch"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        new = s["since"].isNull() | (s["n"] >= most) | (r["ms"] - s["since"] >= timeout_ms)
        batch = F.when(new, s["batch"] + 1).otherwise(s["batch"])
        return F.struct(F.when(new, 1).otherwise(s["n"] + 1).alias("n"), F.when(new, r["ms"]).otherwise(s["since"]).alias("since"), batch.alias("batch"), F.concat(s["out"], F.array(batch)).alias("out"))

    numbers = F.aggregate("a", start, step, lambda s: s["out"])
    return packed.select(F.inline(F.zip_with("a", numbers, lambda r, b: F.struct(r["row"].alias("row"), b.alias("batch_no"))))).select("row.*", "batch_no")


def count_batches(requests: DataFrame, most: int = 8, queue: str = "queue_id", order: str = "request_id") -> DataFrame:
    """Adds batch_no of batches by count alone."""
    return requests.withColumn("batch_no", F.floor((F.row_number().over(Window.partitionBy(queue).orderBy(order)) - 1) / most))
