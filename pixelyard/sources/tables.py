"""Scans and sinks: images, label metadata, dictionaries, concepts, raw tensors, tokenizers."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.text import parse_labels


def read_images(spark: SparkSession, path: str, drop_invalid: bool = True) -> DataFrame:
    """Image files as rows (origin, image_id, width, height, channels, data): B, G, R in rows, decoded in the JVM."""
    rows = spark.read.format("image").option("dropInvalid", drop_invalid).load(path).select("image.*")
    return rows.select("origin", F.xxhash64("origin").alias("image_id"), "width", "height", F.col("nChannels").alias("channels"), "data")


def image_literal(image_id: Column, width: Column, height: Column, channels: Column, data: Column) -> Column:
    """An image row of given parts; bytes that don't fit the size are an error."""
    fits = F.length(data) == width * height * channels
    checked = F.when(fits, data).otherwise(F.raise_error(F.lit("the bytes don't fit the image's size")).cast("binary"))
    return F.struct(image_id.alias("image_id"), width.alias("width"), height.alias("height"), channels.alias("channels"), checked.alias("data"))


def pixel(data: Column, width: Column, channels: Column, x: Column, y: Column, channel: int = 0) -> Column:
    """One byte of an image, 0 to 255."""
    at = ((y * width + x) * channels + channel + 1).cast("int")
    return F.conv(F.hex(data.substr(at, F.lit(1))), 16, 10).cast("int")


def pixels(images: DataFrame) -> DataFrame:
    """Image rows as a long table image_id, y, x, channel, v."""
    codes = F.expr("transform(sequence(1, length(data)), i -> cast(conv(hex(substring(data, i, 1)), 16, 10) as int))")
    rows = images.where("length(data) > 0").select("image_id", "width", "channels", F.posexplode(codes).alias("i", "v"))
    at = F.floor(F.col("i") / F.col("channels"))
    return rows.select("image_id", F.floor(at / F.col("width")).cast("int").alias("y"), (at % F.col("width")).cast("int").alias("x"), (F.col("i") % F.col("channels")).alias("channel"), "v")


def write_images(images: DataFrame, path: str) -> None:
    """Image rows as Parquet, which keeps sizes and bytes as they are and is written by each executor where the cluster's files are."""
    images.select("image_id", "width", "height", "channels", "data").write.mode("overwrite").parquet(path)


def export_ppm(images: DataFrame, path: str) -> int:
    """Image rows as portable pixmaps in a folder that the executors share; returns their number."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                a = a[..., :3][..., ::-1] if r.channels >= 3 else np.repeat(a, 3, axis=2)
                Path(path, f"{r.image_id}.ppm").write_bytes(b"P6 %d %d 255\n" % (r.width, r.height) + a.tobytes())
            yield pd.DataFrame({"n": [len(batch)]})

    Path(path).mkdir(parents=True, exist_ok=True)
    return images.select("image_id", "width", "height", "channels", "data").mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


def labels_from(metadata: DataFrame, text: str = "names") -> DataFrame:
    """class_id and name of a model's label metadata."""
    return metadata.select(F.posexplode(parse_labels(F.col(text))).alias("class_id", "name"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """idx and char of a character file, one entry a line; blank lines at the end are left out, an empty file is an error."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"[\r\n]+$", "").alias("t")).where("t <> ''")
    if lines.isEmpty():
        raise InvalidArgument(f"{path} holds no characters")
    return lines.select(F.posexplode(F.split("t", r"\r?\n")).alias("idx", "char"))


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """concept_id and concept of a file with one a line; blank lines and those that start with # are left out."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "t")).select("line", F.trim("t").alias("concept"))
    return lines.where("concept <> '' and not startswith(concept, '#')").select(F.col("line").alias("concept_id"), "concept")


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """origin and f32 (an array) of files of little-endian single-precision numbers."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"origin": batch["path"], "f32": [np.frombuffer(b[: len(b) // 4 * 4], "<f4") for b in batch["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "origin string, f32 array<float>")


def tokenize(texts: DataFrame, tokenizer_file: str, length: int, text: str = "text", pad_id: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """ids and attention mask of exactly `length` tokens, cut and padded at the right.

    tokenizer_file is a tokenizer description that every executor can open, as one sent with addFile.
    """
    schema = ", ".join(f"{c} {dict(texts.dtypes)[c]}" for c in (*keep, text))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        for batch in batches:
            ids = [e.ids[:length] for e in tokenizer.encode_batch(batch[text].fillna("").tolist())]
            yield batch.assign(ids=[i + [pad_id] * (length - len(i)) for i in ids], mask=[[1] * len(i) + [0] * (length - len(i)) for i in ids])

    return texts.select(*keep, text).mapInPandas(encode, f"{schema}, ids array<int>, mask array<int>")


def wordpiece(text: str, vocabulary: dict[str, int], most: int = 256, unknown: str = "[UNK]") -> list[int]:
    """Greedy longest-match pieces of lower-cased words between the start and end tokens, at most `most`."""
    import re

    out = [vocabulary["[CLS]"]]
    for word in re.findall(r"\w+|[^\w\s]", text.lower()):
        pieces, at = [], 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), None)
            if end is None:
                pieces = [vocabulary[unknown]]
                break
            pieces.append(vocabulary[("##" if at else "") + word[at:end]])
            at = end
        out += pieces
    return [*out[: most - 1], vocabulary["[SEP]"]]
