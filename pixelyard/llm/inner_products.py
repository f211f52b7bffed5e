"""Exact top-k inner products: vectors by descending length, rotated partial sums, Cauchy-Schwarz bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vectors_of(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of numbers as rows of integers; a shorter one counts as padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), width), np.int64)
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def rotation_of(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all vectors, from sums of outer products: width * width numbers a task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = vectors_of(batch.column("v"), width).astype(np.float64)
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "s"])

    gram = np.zeros((width, width))
    for i, j, s in vectors.select("v").mapInArrow(sums, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s")).toLocalIterator():
        gram[i, j] = s
    return np.linalg.eigh(gram)[1][:, ::-1]


def search_block(queries: np.ndarray, query_ids: np.ndarray, found: np.ndarray, ids: np.ndarray, own: np.ndarray, rotation: np.ndarray, k: int, lead: int, step: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, candidate row and score of the k best candidates of each query, own row left out.

    Candidates go by descending length.  A query is done once its length times the next candidate's is
    below its k-th score.  Of the others, the first `lead` rotated coordinates are multiplied; the rest
    adds no more than the product of the remaining lengths, and only pairs that may still reach the k-th
    score are multiplied in full, in integers.
    """
    order = np.argsort(-np.einsum("ij,ij->i", found.astype(np.float64), found.astype(np.float64)), kind="stable")
    found, ids, own = found[order], ids[order], own[order]
    turned_q, turned_c = queries @ rotation, found @ rotation
    length = lambda x: np.sqrt(np.einsum("ij,ij->i", x, x))
    norm_q, norm_c = length(turned_q), length(turned_c)
    rest_q, rest_c = length(turned_q[:, lead:]), length(turned_c[:, lead:])
    threshold = np.full(len(queries), -np.inf)
    exact = norm_q.max(initial=0.0) * norm_c.max(initial=0.0) < 2.0**52  # all products are whole numbers in double precision
    whole_q, whole_c = queries.astype(np.float64), found.astype(np.float64)
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    a = 0
    while a < len(found):
        b = min(len(found), a + min(step, max(2 * k, a)))
        slack = 1e-9 * (1 + norm_q * norm_c[a])  # for rounding in the bounds
        live = np.flatnonzero(norm_q * norm_c[a] + slack >= threshold)
        if not len(live):
            break
        bound = turned_q[live, :lead] @ turned_c[a:b, :lead].T
        bound += rest_q[live, None] * rest_c[None, a:b]
        may = bound + slack[live, None] >= threshold[live, None]
        if exact and np.count_nonzero(may) * 16 > may.size:  # many pairs are left: one matrix product for all
            full = np.rint(whole_q[live] @ whole_c[a:b].T)
            q, c = np.nonzero(may & (full >= threshold[live, None]))
            score = full[q, c].astype(np.int64)
            q, c = live[q], c + a
        else:
            q, c = np.nonzero(may)
            q, c = live[q], c + a
            score = np.empty(len(q), np.int64)
            for x in range(0, len(q), 1 << 16):
                part = slice(x, x + (1 << 16))
                score[part] = np.einsum("ij,ij->i", queries[q[part]], found[c[part]])
        keep = (own[c] != query_ids[q]) & (score >= threshold[q])
        touched = np.zeros(len(queries), bool)
        touched[q[keep]] = True
        old = touched[best[0]]
        q, c, score = np.concatenate([best[0][old], q[keep]]), np.concatenate([best[1][old], c[keep]]), np.concatenate([best[2][old], score[keep]])
        by = np.lexsort((ids[c], -score, q))
        q, c, score = q[by], c[by], score[by]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, c, score = q[keep], c[keep], score[keep]
        counts = np.bincount(q, minlength=len(queries))
        last = np.cumsum(counts) - 1
        enough = counts == k
        threshold[enough] = score[last[enough]]
        best = (np.concatenate([best[0][~old], q]), np.concatenate([best[1][~old], c]), np.concatenate([best[2][~old], score]))
        a = b
    return best[0], order[best[1]], best[2]


def top_inner_products(
    rows: DataFrame,
    is_query,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    scale: float = 64.0,
    lead: int = 16,
    shard_rows: int = 8192,
    query_rows: int = 4096,
) -> DataFrame:
    """The k highest integer inner products of each query row with all rows but itself.

    Components become floor(scale * x) in double precision.  is_query is a condition on the id column.
    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id, fewer rows than k are all
    returned.  Rows whose vector is null, empty or holds null or non-finite numbers, and rows without an
    id, take no part.  Rows with one id are rows of their own: each is a candidate for the other.  Scores
    are 64-bit integers: a component beyond the bound up to which no score of vectors this wide can leave
    them, the root of (2**63 - 1) / width, counts as that bound.  Other columns are left out.

    Queries, in blocks of query_rows, meet candidates, in shards of shard_rows dealt by hash, so that each
    shard has long vectors of its own to start with.  A task holds one block and one shard; the partial
    results, k a query and shard, are merged by a window.
    """
    x = F.col(vector_col)
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) != float("inf")))
    clean = rows.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double"))).alias("v"))
    # own: what tells a row from others of the same id
    clean = clean.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("v")))
    told = clean.agg(F.count(F.lit(1)), F.max(F.size("v")), F.count_if(is_query(F.col("id")))).first()
    total, width, asked = told[0], told[1] or 1, told[2]
    shards, blocks = max(1, -(-total // shard_rows)), max(1, -(-asked // query_rows))
    lead = min(lead, width)
    most = math.isqrt((2**63 - 1) // width)
    clean = clean.withColumn("v", F.transform("v", lambda e: F.greatest(F.lit(-most), F.least(F.lit(most), e))))
    rotation = rotation_of(clean, width)
    spread = F.xxhash64("id", "nth")
    queries = clean.where(is_query(F.col("id"))).withColumn("block", F.pmod(spread, F.lit(blocks)))
    queries = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")))
    found = clean.withColumn("shard", F.pmod(spread, F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        q, c = vectors_of(left["v"], width), vectors_of(right["v"], width)
        qid, cid = left["id"].to_numpy(), right["id"].to_numpy()
        # a row's number among all: own rows are equal in id and nth
        pairs = np.concatenate([np.stack([qid, left["nth"].to_numpy()], 1), np.stack([cid, right["nth"].to_numpy()], 1)])
        number = np.unique(pairs, axis=0, return_inverse=True)[1].ravel()
        i, j, score = search_block(q, number[: len(q)], c, cid, number[len(q) :], rotation, k, lead)
        return pa.table({"query_id": qid[i], "nth": left["nth"].to_numpy()[i].astype(np.int32), "vec_id": cid[j], "score": score})

    parts = queries.groupBy("block", "shard").cogroup(found.groupBy("block", "shard")).applyInArrow(search, "query_id long, nth int, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id", "nth").orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
