"""Weighted fair queueing of sources towards target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: virtual finish times are counted in so many steps before the cut is sought exactly within one
STEPS = 1 << 13


def source_targets(sizes: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """Adds source_rank (by code point, null last) and target to rows of source, source_size, source_rows.

    All sizes together are shared by weight; a target stops at `epochs` times its source's size and the
    excess is shared by weight among the rest, until none is above.  In the order of size to weight the
    sources that stop are the first ones, so running sums give the share of the others.
    """
    ordered = sizes.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("stop", "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    level = ordered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(epochs)).withColumn("stop", F.col("cap") / F.col("weight"))
    level = level.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    rest = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = level.withColumn("rest", rest)
    share = F.min(F.when(F.col("rest") <= F.col("stop"), F.struct("stop", "source_rank", "rest"))).over(everything)["rest"]  # of the first that doesn't stop
    return level.withColumn("target", F.least("cap", F.col("weight") * share)).select("source", "source_size", "source_rows", "source_rank", "target")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    epochs: int = 3,
    seed: int = 1,
    carry: bool = False,
) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken.

    A document's size is its number of words of spaces (null: 0).  Within each source documents stand
    in a shuffled order, the order of md5(seed, id); copy e of a document has the virtual finish time
    (e * source size + sizes up to and with it) / target.  Copies of all sources, by finish time, are
    taken as long as their sizes together don't exceed the size of the corpus.  taken counts the words
    of a document's taken copies, of which there are `epochs` at most.  A source without words has
    target 0.  A null source is a source; null ids and repeated rows are documents of their own.  Other
    columns are left out; with carry all columns but the id come back as the struct `rest`.

    Nothing is sorted in one place: running sums within a source go by buckets of the shuffled order,
    about as many as rows in each, and the cut is found from a histogram of finish times and then within
    its one step.  Only the cut reaches the driver.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))))
    rest = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != id_col)).alias("rest")] if carry else []
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"), *rest)).df
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    # a row a source: written once, as every later step needs it
    targets = scratch.keep(source_targets(sizes, weights, epochs)).df
    sourced = rows.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "source")
    spot = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    sourced = sourced.withColumn("bucket", F.floor(spot * F.ceil(F.sqrt("source_rows"))).cast("long"))
    sums = sourced.groupBy("source_rank", "bucket").agg(F.sum("size").alias("s"))
    ahead = sums.select("source_rank", "bucket", (F.sum("s").over(Window.partitionBy("source_rank").orderBy("bucket")) - F.col("s")).alias("ahead"))
    inner = Window.partitionBy("source_rank", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = sourced.join(ahead, ["source_rank", "bucket"]).withColumn("upto", F.col("ahead") + F.sum("size").over(inner))
    queued = scratch.keep(queued.drop("bucket", "ahead", "source_rows")).df

    def finish(copy: int):
        return F.try_divide((F.col("source_size") * F.lit(copy) + F.col("upto")).cast("double"), F.col("target"))

    copies = queued.where("size > 0").select("size", "source_rank", "key", "id", F.explode(F.array(*[finish(e) for e in range(epochs)])).alias("finish"))
    step = F.least(F.floor(F.col("finish") * F.lit(STEPS)), F.lit(2 * STEPS - 1)).cast("long")
    copies = copies.withColumn("step", step)
    counted = copies.groupBy("step").agg(F.sum("size").alias("s"))
    total = queued.agg(F.sum("size")).first()[0] or 0
    reach = counted.select("step", "s", F.sum("s").over(Window.orderBy("step")).alias("reached"))
    at = reach.where(F.col("reached") > total).orderBy("step").limit(1).first()
    order = ["finish", "source_rank", "key", "id"]
    cut = None
    if at is not None:  # the last copy taken in the step at which the total is exceeded
        within = copies.where(F.col("step") == at["step"]).withColumn("reached", F.sum("size").over(Window.partitionBy("step").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        past = within.where(F.col("reached") + F.lit(at["reached"] - at["s"]) > total).orderBy(*order).limit(1).first()
        cut = F.struct(*[F.lit(past[c]).alias(c) for c in order])
    taken = F.lit(0)
    for e in range(epochs):
        stands = F.struct(finish(e).alias("finish"), *order[1:])
        taken = taken + F.when(F.lit(True) if cut is None else stands < cut, 1).otherwise(0)
    taken = F.when(F.col("size") > 0, F.col("size") * taken).otherwise(0).cast("long")
    return queued.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), *(["rest"] if carry else []))
