"""Tables that stand in for images and model outputs, derived from whole driver tables.

Each SQL_ text is DuckDB's form of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOX_COLUMNS = """
    CAST(floor(l_orderkey / 20) AS BIGINT) AS img, CAST(l_linenumber % 3 AS INT) AS cls,
    CAST((l_partkey * 37) % 200 AS DOUBLE) AS x1, CAST((l_suppkey * 53) % 200 AS DOUBLE) AS y1,
    CAST((l_partkey * 37) % 200 AS DOUBLE) + 20 + l_quantity AS x2, CAST((l_suppkey * 53) % 200 AS DOUBLE) + 20 + l_quantity / 2 AS y2,
    round(CAST(0.05 AS DOUBLE) + (l_extendedprice * 100 % 9500) / 10000, 6) AS score"""
BOX_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"
BOX_SEQ = f"row_number() OVER (PARTITION BY CAST(floor(l_orderkey / 20) AS BIGINT) ORDER BY {BOX_ORDER}) AS seq"
SQL_BOXES = f"boxes AS (SELECT {BOX_COLUMNS}, {BOX_SEQ} FROM lineitem)"
SQL_GRAY = "gray AS (SELECT vec_id AS img, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, CAST(least(255, greatest(0, floor(embedding[i] * 256 + 128))) AS INT) AS v FROM embeddings, range(1, 65) t(i))"
SQL_LOGITS = "logits AS (SELECT vec_id AS id, CAST(i - 1 AS INT) AS k, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i))"
SQL_SIZES = "sizes AS (SELECT o_orderkey AS img, CAST(256 + o_orderkey % 2000 AS INT) AS w, CAST(256 + o_custkey % 1500 AS INT) AS h FROM orders)"
SQL_FRAMES = "frames AS (SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_no, event_id, value, ts FROM events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates img, cls, seq, x1, y1, x2, y2, score: 20 orders make an image."""
    return table(spark, sf_dir, "lineitem").selectExpr(*columns(BOX_COLUMNS), BOX_SEQ)


def columns(text: str) -> list[str]:
    """The top-level comma-parted parts of a select list."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    return [*parts, text[start:]]


def gray_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 gray images as arrays: img, data, width, height.

    The sum is in the precision of the embedding, as in SQL_GRAY; with whole numbers Spark would take it in double precision.
    """
    scale, shift = F.lit(256.0).cast("float"), F.lit(128.0).cast("float")
    data = F.transform("embedding", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(e * scale + shift))).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img"), data.alias("data"), F.lit(8).alias("width"), F.lit(8).alias("height"))


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, a row per pixel: img, y, x, v."""
    return gray_arrays(spark, sf_dir).select("img", F.posexplode("data").alias("i", "v")).select("img", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), "v")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and scores: 64 class scores in double precision."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("scores"))


def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS img", "CAST(256 + o_orderkey % 2000 AS INT) AS w", "CAST(256 + o_custkey % 1500 AS INT) AS h")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id AS seq_id", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_no", "event_id", "value", "ts")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gray images as image rows with one channel."""
    codes = F.array_join(F.transform("data", lambda v: F.lpad(F.hex(v), 2, "0")), "")
    return gray_arrays(spark, sf_dir).select(F.col("img").alias("image_id"), "width", "height", F.lit(1).alias("channels"), F.unhex(codes).alias("data"))
