"""Quality by compression: zstandard dictionaries of good and of bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import MAX_BYTES, fit_logistic, labelled_sample, predict_logistic, without_copies
from .textops import text_pieces

#: bytes compressed at a time, so that a dictionary counts for every part of a text alike
BLOCK = 256
#: bytes of a frame's header
HEADER = 6


def compressed_size(kind: zstandard.ZstdCompressor, text: bytes) -> int:
    """The sizes of a text's consecutive blocks together, each compressed against the dictionary by itself."""
    return sum(len(kind.compress(text[a : a + BLOCK])) - HEADER for a in range(0, len(text), BLOCK))


@dataclass
class CompressionModel:
    """Two dictionaries and the calibration of the size difference; picklable, so executors build their own compressors."""

    bad: bytes
    good: bytes
    trained: bool = True
    level: int = 3
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    kinds: list | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kinds": None}

    def sizes(self, texts: list[bytes]) -> np.ndarray:
        """Bytes under the bad and under the good dictionary."""
        if self.kinds is None:
            self.kinds = []
            for data in (self.bad, self.good):
                held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if self.trained else zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(level=self.level)
                self.kinds.append(zstandard.ZstdCompressor(dict_data=held, level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False))
        bad, good = self.kinds
        return np.array([(compressed_size(bad, t), compressed_size(good, t)) for t in texts], np.float64).reshape(-1, 2)

    def measures(self, texts: list[bytes]) -> np.ndarray:
        """The difference of the sizes by the length, and the logarithm of the smaller by the length, a quarter at most.

        The second tells texts that say one thing over and over: either dictionary makes next to nothing of them,
        so their difference is none.  A quarter is less than what prose shrinks to, so there it is one constant.
        """
        b, g = self.sizes(texts).T
        n = np.array([max(1, len(t)) for t in texts], np.float64)
        least = np.where(np.minimum(b, g) > 0, np.minimum(b, g) / n, 1.0)
        return np.column_stack([(b - g) / n, np.log(np.clip(least, 1 / 64, 1 / 4))])

    def calibrate(self, texts: list[bytes], labels: np.ndarray) -> None:
        x = self.measures(texts)
        spread = x.std(axis=0)
        self.mean, self.scale = x.mean(axis=0), np.where(spread > 1e-6, spread, 1.0)
        self.weights = fit_logistic((x - self.mean) / self.scale, labels, ridge=1.0)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return predict_logistic((self.measures(texts) - self.mean) / self.scale, self.weights)


def dictionary_of(texts: list[bytes], size: int, piece: int = 1024, pieces: int = 8) -> tuple[bytes, bool]:
    """A trained dictionary, or (False) plain content where there is too little text to train one.

    From `pieces` evenly spaced pieces of each text, so that none outweighs the others.
    """
    parts = []
    for t in texts:
        starts = range(0, len(t), piece)
        parts += [t[a : a + piece] for a in (starts if len(starts) <= pieces else [starts[k * len(starts) // pieces] for k in range(pieces)])]
    try:
        return zstandard.train_dictionary(size, parts, k=64, d=6).as_bytes(), True
    except zstandard.ZstdError:
        return b"\n".join(parts)[-size:], False


def train_quality(texts: list[bytes], labels: np.ndarray, dictionary_bytes: int = 112 << 10) -> CompressionModel | None:
    """Dictionaries from half of each label's texts, calibration on the others; None if a label is missing.

    Near copies of a text in the sample count once: a label on one of them says nothing on words that all have.
    """
    keep = [i for i in without_copies(texts) if texts[i]]
    held = [[i for i in keep if labels[i] == q] for q in (0, 1)]
    if not all(held):
        return None
    halves = [h[: (len(h) + 1) // 2] for h in held]
    bad, good = (dictionary_of([texts[i] for i in h], dictionary_bytes) for h in halves)
    if bad[1] != good[1]:  # one kind of dictionary for both, so that they differ by content alone
        bad, good = ((b"\n".join(texts[i] for i in h)[-dictionary_bytes:], False) for h in halves)
    model = CompressionModel(bad[0], good[0], bad[1])
    rest = [i for h in held for i in (h[(len(h) + 1) // 2 :] or h)]
    model.calibrate([texts[i] for i in rest], labels[rest])
    return model


def score_quality(docs: DataFrame, model: CompressionModel | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Adds score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold) to all columns of docs.

    Null texts are scored as empty ones.  Without a model, for want of labels, each score is 0.5.  Columns of
    docs named score or predicted are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.drop("score", "predicted")
    plain = plain.withColumn(text_col, F.col(text_col).cast("string"))
    at = plain.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5)
            if shared.value is not None:
                for a, b, texts in text_pieces(batch.column(at)):
                    scores[a:b] = shared.value.score(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    scored = plain.mapInArrow(score, f"{schema}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 6000, max_bytes: int = MAX_BYTES) -> CompressionModel | None:
    """A model from at most max_rows labelled rows of max_bytes together whose crc32(id as text) mod 5 is not 0."""
    learn = F.crc32(F.col(id_col).cast("string")) % 5 != 0
    return train_quality(*labelled_sample(docs, labels, "quality", max_rows, id_col, text_col, learn, max_bytes))
