"""Scoring: a model as a stage between image and tensor tables.

One session a Python worker, opened on its first batch; Arrow batches are the model's batches.
"""

from __future__ import annotations

import contextlib
import os
import struct
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..errors import InferenceError, InvalidArgument, ModelNotFound
from .preprocess import PreprocessSpec, preprocess

TENSORS = "image_id long, output_idx int, name string, shape array<long>, f32 array<float>, i64 array<long>, error string"


class Scorer(Protocol):
    """A model: takes [N, C, H, W] and returns its outputs, each with N first, with their names."""

    def __call__(self, batch: np.ndarray) -> list[tuple[str, np.ndarray]]: ...


def providers(wanted: list[str] | None = None) -> list[str]:
    """Those of the wanted execution providers that are there, the CPU's last."""
    import onnxruntime

    there = onnxruntime.get_available_providers()
    return [*(p for p in wanted or ["CUDAExecutionProvider"] if p in there and p != "CPUExecutionProvider"), "CPUExecutionProvider"]


def open_session(path: str | bytes, threads: int = 1, wanted: list[str] | None = None):
    """A session of a model file, or of a model given as bytes."""
    import onnxruntime

    if isinstance(path, bytes):
        pass
    elif not path.strip():
        raise InvalidArgument("a model needs a path")
    elif not os.path.exists(path):
        raise ModelNotFound(path)
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = threads
    options.graph_optimization_level = onnxruntime.GraphOptimizationLevel.ORT_ENABLE_ALL
    return onnxruntime.InferenceSession(path, options, providers(wanted))


def onnx_scorer(path: str | bytes, threads: int = 1) -> Callable[[], Scorer]:
    """Opens a model on the worker; a path that isn't there is looked up among the files sent with addFile.

    A small model may be given as bytes, which then travel with the task.
    """

    def open_() -> Scorer:
        from pyspark import SparkFiles

        here = isinstance(path, bytes) or os.path.exists(path)
        session = open_session(path if here else SparkFiles.get(os.path.basename(path)), threads)
        name, outputs = session.get_inputs()[0].name, [o.name for o in session.get_outputs()]
        return lambda batch: list(zip(outputs, session.run(None, {name: batch})))

    return open_


def describe_model(spark: SparkSession, path: str) -> DataFrame:
    """Inputs, outputs and metadata of a model: kind, name, shape (as text), type."""
    session = open_session(path)
    rows = [(kind, x.name, str(x.shape), x.type) for kind, xs in (("input", session.get_inputs()), ("output", session.get_outputs())) for x in xs]
    rows += [("metadata", k, v, "text") for k, v in session.get_modelmeta().custom_metadata_map.items()]
    return spark.createDataFrame(rows, "kind string, name string, shape string, type string")


def input_size(path: str, fallback: int = 640) -> tuple[int, int, int]:
    """Channels, height and width of the first input; dynamic ones are 3 and the fallback."""
    shape = open_session(path).get_inputs()[0].shape
    known = [s if isinstance(s, int) and s > 0 else None for s in [*shape, None, None, None, None][1:4]]
    return known[0] or 3, known[1] or fallback, known[2] or fallback


def tensor_rows(ids: list[int], outputs: list[tuple[str, np.ndarray]]) -> Iterator[tuple]:
    for k, (name, value) in enumerate(outputs):
        if value.shape[:1] != (len(ids),):
            raise InferenceError(f"output {name} of shape {value.shape} has no row for each of {len(ids)} images")
        whole = np.issubdtype(value.dtype, np.integer) or value.dtype == bool
        for i, one in zip(ids, value):
            flat = one.ravel()
            yield i, k, name, list(one.shape), None if whole else flat.astype(np.float32), flat.astype(np.int64) if whole else None, None


def score_images(images: DataFrame, open_scorer: Callable[[], Scorer], spec: PreprocessSpec, batch_rows: int = 8) -> DataFrame:
    """A row per image and output.  An image that can't be read, or a batch that fails, gives a row with only `error`.

    Images of one shape after preprocessing go through the model together, batch_rows at most; if that fails,
    one by one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = open_scorer()
        names = ["image_id", "output_idx", "name", "shape", "f32", "i64", "error"]
        for batch in batches:
            out: list[tuple] = []
            ready: dict[tuple, list[tuple[int, np.ndarray]]] = {}
            for r in batch.itertuples():
                try:
                    x = preprocess(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels), spec)
                    ready.setdefault(x.shape, []).append((r.image_id, x))
                except Exception as e:  # noqa: BLE001
                    out.append((r.image_id, -1, None, None, None, None, str(e)))
            for group in ready.values():
                for at in range(0, len(group), batch_rows):
                    part = group[at : at + batch_rows]
                    try:
                        out += tensor_rows([i for i, _ in part], scorer(np.stack([x for _, x in part])))
                    except Exception:  # noqa: BLE001
                        for i, x in part:
                            try:
                                out += tensor_rows([i], scorer(x[None]))
                            except Exception as e:  # noqa: BLE001
                                out.append((i, -1, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=names)

    return images.select("image_id", "width", "height", "channels", "data").mapInPandas(run, TENSORS)


def score_named(rows: DataFrame, open_scorer: Callable[[], Callable[[dict[str, np.ndarray]], list[tuple[str, np.ndarray]]]], inputs: dict[str, tuple[str, tuple[int, ...]]], key: str = "image_id") -> DataFrame:
    """As score_vectors, for models of several inputs: each is a column of flat arrays and the shape of one row's.

    One size of a shape may be -1.  Columns of whole numbers go in as such, others in single precision.  A row is
    scored by itself, as rows differ in their shapes; one that fails, or lacks an input, gives a row with only `error`.
    """
    columns = [c for c, _ in inputs.values()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = open_scorer()
        for batch in batches:
            out: list[tuple] = []
            for i, *values in zip(batch[key], *(batch[c] for c in columns)):
                try:
                    given = {}
                    for (name, (column, shape)), value in zip(inputs.items(), values):
                        if value is None:
                            raise InvalidArgument(f"no {column} for input {name}")
                        x = np.asarray(value)
                        given[name] = (x.astype(np.int64) if np.issubdtype(x.dtype, np.integer) else x.astype(np.float32)).reshape(1, *shape)
                    out += tensor_rows([i], scorer(given))
                except Exception as e:  # noqa: BLE001
                    out.append((i, -1, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["image_id", "output_idx", "name", "shape", "f32", "i64", "error"])

    return rows.select(key, *dict.fromkeys(columns)).mapInPandas(run, TENSORS)


def onnx_named_scorer(path: str | bytes, threads: int = 1) -> Callable[[], Callable[[dict[str, np.ndarray]], list[tuple[str, np.ndarray]]]]:
    """onnx_scorer for models of several inputs: takes arrays by the inputs' names."""

    def open_():
        from pyspark import SparkFiles

        here = isinstance(path, bytes) or os.path.exists(path)
        session = open_session(path if here else SparkFiles.get(os.path.basename(path)), threads)
        wanted, outputs = {x.name for x in session.get_inputs()}, [o.name for o in session.get_outputs()]

        def score(given: dict[str, np.ndarray]) -> list[tuple[str, np.ndarray]]:
            if missing := wanted - set(given):
                raise InvalidArgument(f"the model also takes {sorted(missing)}")
            return list(zip(outputs, session.run(None, {k: v for k, v in given.items() if k in wanted})))

        return score

    return open_


def predict(images: DataFrame, open_scorer: Callable[[], Scorer], spec: PreprocessSpec, finish: Callable[[dict[str, np.ndarray], int, int], list[tuple]], schema: str, batch_rows: int = 8, warm_up: bool = False) -> DataFrame:
    """Images through a model and what follows it, in one Arrow stage: finish makes the rows of one image.

    finish takes the image's outputs by name, in the model's order, its width and height.  Neither images nor
    outputs leave their partition.  image_id stands before and error after the columns of schema; an image that
    can't be read or scored gives a row with only these.  With warm_up a worker scores an empty image first, so
    that its first batch isn't slower than others.
    """
    full = f"image_id long, {schema}, error string"
    kinds = to_arrow_schema(_parse_datatype_string(full))
    names, width = [f.name for f in kinds], len(kinds) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = open_scorer()
        if warm_up:
            with contextlib.suppress(Exception):
                scorer(preprocess(np.zeros((spec.height, spec.width, 3), np.uint8), spec)[None])
        for batch in batches:
            out: list[tuple] = []
            ready: dict[tuple, list[tuple[int, int, int, np.ndarray]]] = {}
            for r in batch.to_pylist():
                try:
                    x = preprocess(np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"]), spec)
                    ready.setdefault(x.shape, []).append((r["image_id"], r["width"], r["height"], x))
                except Exception as e:  # noqa: BLE001
                    out.append((r["image_id"], *[None] * width, str(e)))
            for group in ready.values():
                for at in range(0, len(group), batch_rows):
                    part = group[at : at + batch_rows]
                    try:
                        scored = scorer(np.stack([x for *_, x in part]))
                    except Exception:  # noqa: BLE001
                        scored = None
                    for k, (i, w, h, x) in enumerate(part):
                        try:
                            mine = {n: v[k] for n, v in scored} if scored is not None else {n: v[0] for n, v in scorer(x[None])}
                            out += [(i, *row, None) for row in finish(mine, w, h)]
                        except Exception as e:  # noqa: BLE001
                            out.append((i, *[None] * width, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out) if out else [[]] * (width + 2), kinds)], names)

    return images.select("image_id", "width", "height", "channels", "data").mapInArrow(run, full)


def score_vectors(rows: DataFrame, open_scorer: Callable[[], Scorer], vector: str, key: str = "image_id") -> DataFrame:
    """As score_images, for rows that hold model input already, as arrays of one length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = open_scorer()
        for batch in batches:
            out = tensor_rows(batch[key].tolist(), scorer(np.stack([np.asarray(v, np.float32) for v in batch[vector]]))) if len(batch) else []
            yield pd.DataFrame(list(out), columns=["image_id", "output_idx", "name", "shape", "f32", "i64", "error"])

    return rows.select(key, vector).mapInPandas(run, TENSORS)


def output(tensors: DataFrame, name: str | None = None, index: int | None = None) -> DataFrame:
    """One output of each image, by name or index."""
    good = tensors.where("error is null")
    return good.where(good.name == name) if name is not None else good.where(good.output_idx == (0 if index is None else index))


def micro_model(operator: str, width: int, metadata: dict[str, str] | None = None, axis: int | None = None) -> bytes:
    """A model of one operator over rows of `width` numbers, for tests, in the interchange format's wire encoding."""

    def varint(n: int) -> bytes:
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    def field(number: int, value) -> bytes:
        if isinstance(value, int):
            return varint(number << 3) + varint(value)
        value = value.encode() if isinstance(value, str) else value
        return varint(number << 3 | 2) + varint(len(value)) + value

    def info(name: str) -> bytes:
        shape = field(1, field(2, "N")) + field(1, field(1, width))
        return field(1, name) + field(2, field(1, field(1, 1) + field(2, shape)))

    attribute = b"" if axis is None else field(5, field(1, "axis") + field(3, axis) + field(20, 2))
    node = field(1, "x") + field(2, "y") + field(4, operator) + attribute
    graph = field(1, node) + field(2, "micro") + field(11, info("x")) + field(12, info("y"))
    extra = b"".join(field(14, field(1, k) + field(2, v)) for k, v in (metadata or {}).items())
    return field(1, 8) + field(7, graph) + field(8, field(2, 13)) + extra


def read_f32(data: bytes) -> np.ndarray:
    """Little-endian single-precision numbers."""
    return np.array(struct.unpack(f"<{len(data) // 4}f", data[: len(data) // 4 * 4]), np.float32)
