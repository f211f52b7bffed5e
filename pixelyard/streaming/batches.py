"""Streams: images through a scorer in micro-batches, and windows of recent frames as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.preprocess import PreprocessSpec
from ..plans.scoring import score_images


def image_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """New rows of a folder of image Parquet files; files_at_once bounds what a trigger takes in."""
    schema = "image_id long, width int, height int, channels int, data binary"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def score_stream(images: DataFrame, open_scorer, spec: PreprocessSpec, batch_rows: int = 8) -> DataFrame:
    """Tensors of a stream of images; each trigger is a batch, cut into model batches of batch_rows."""
    return score_images(images, open_scorer, spec, batch_rows)


def recent_frames(frames: DataFrame, most: int = 30, sequence: str = "seq_id", at: str = "frame_no", value: str = "value", idle: str = "10 minutes") -> DataFrame:
    """For each sequence with new frames: its last `most` frames, oldest first.

    The state is those frames; it goes when a sequence has been idle.  Frames of a trigger are taken in order
    of their number; late ones are placed by it while they are among the last.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get)) if state.exists else []
        for batch in batches:
            held += list(zip(batch[at].tolist(), batch[value].tolist()))
        held = sorted(dict(held).items())[-most:]
        numbers, values = [n for n, _ in held], [float(v) for _, v in held]
        state.update((numbers, values))
        state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))
        yield pd.DataFrame({sequence: [key[0]], "frames": [numbers], "values": [values]})

    kind = dict(frames.dtypes)[sequence]
    return frames.select(sequence, at, F.col(value).cast("double").alias(value)).groupBy(sequence).applyInPandasWithState(
        update, f"{sequence} {kind}, frames array<long>, values array<double>", "frames array<long>, values array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by time window and kind, with late ones up to `late`."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")
