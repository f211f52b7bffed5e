"""A bounded sample of labelled documents, and a logistic model fitted to it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_duplicates import shingle_sets
from .textops import mix


#: bytes of a sample's texts together
MAX_BYTES = 48 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text", where=None, max_bytes: int = MAX_BYTES) -> tuple[list[bytes], np.ndarray]:
    """Texts and 0/1 labels of labelled documents, in an order fixed by their ids.

    The only thing a model sees of the corpus.  max_rows labelled documents are drawn; of these, in their order,
    all whose texts fit into max_bytes together.  Both bound what is broadcast and collected.  Rows without an id
    or a label are left out, and so are labels of documents that aren't there.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    known = known if where is None else known.where(where)
    known = known.join(docs.select(id_col), id_col, "left_semi")
    key = F.md5(F.col(id_col).cast("string"))
    chosen = known.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label"), key.alias("draw")).orderBy("draw", "label").limit(max_rows)
    drawn = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)
    text = docs.select(F.col(id_col).alias("label_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.octet_length(text_col).alias("size"))
    rows = text.join(F.broadcast(drawn), "label_id")
    order = ["draw", "label", "size", "content"]
    found = rows.select("draw", "label", F.coalesce("size", F.lit(0)).alias("size"), F.xxhash64("text").alias("content")).orderBy(*order).limit(max_rows).collect()
    left, taken = max_bytes, []
    for r in found:
        if r["size"] <= left:
            left -= r["size"]
            taken.append(tuple(r))
    kept = docs.sparkSession.createDataFrame(taken, "draw string, label int, size int, content long")
    got = rows.withColumn("size", F.coalesce("size", F.lit(0))).withColumn("content", F.xxhash64("text")).join(F.broadcast(kept.distinct()), order).select("draw", "label", "size", "content", "text")
    got = sorted(got.collect())[: len(taken)]
    return [r["text"].encode() for r in got], np.array([r["label"] for r in got], np.int64)


def without_copies(texts: list[bytes], tries: int = 4) -> np.ndarray:
    """Numbers of the texts that share none of a few smallest shingle hashes with an earlier one.

    A label on one of many copies says nothing on the words that the copies have in common.
    """
    seen: list[set[int]] = [set() for _ in range(tries)]
    keep = []
    for i, s in enumerate(shingle_sets(texts, 5)):
        least = [int(mix(s ^ np.uint64(k * 7919 + 1)).min()) for k in range(tries)] if len(s) else []
        if not any(x in held for x, held in zip(least, seen)):
            keep.append(i)
        for x, held in zip(least, seen):
            held.add(x)
    return np.array(keep, np.int64)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the intercept's) of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-3:
            break
    return w


def predict_logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    # summed row by row, so that a score does not depend on the batch
    return 1 / (1 + np.exp(-np.clip((x * w[:-1]).sum(axis=1) + w[-1], -30, 30)))
