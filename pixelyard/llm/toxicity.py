"""Toxicity by a classifier chain."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import MAX_BYTES, fit_logistic, labelled_sample, predict_logistic, without_copies
from .textops import LETTER_WORDS, LOWER, join_texts, mix, pieces, slice_hashes, text_pieces, words_of

#: seeds of the earlier categories, for which there are no labels: a labelled text with a seed word counts as one
SEEDS: dict[str, tuple[str, ...]] = {
    "insult": ("idiot", "moron", "fool", "stupid", "dumb", "clown", "loser"),
    "contempt": ("worthless", "pathetic", "useless", "trash", "garbage"),
    "disgust": ("disgusting", "scum", "filth", "vermin"),
}
CATEGORIES = (*SEEDS, "toxic")


def word_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's distinct lower-cased words, and their beginnings of 3 to 6 bytes, as sorted 64-bit hashes."""
    out: list[np.ndarray] = []
    for a, b in pieces(texts):
        buf, _, ends = join_texts([t.translate(LOWER) for t in texts[a:b]])
        starts, stops, upto = words_of(buf, ends, LETTER_WORDS)
        hashed = np.stack([slice_hashes(buf, starts, stops), *(mix(slice_hashes(buf, starts, np.minimum(stops, starts + n)) + np.uint64(n)) for n in BEGINNINGS)])
        low = 0
        for high in upto.tolist():
            out.append(np.unique(hashed[:, low:high]))
            low = high
    return out


#: lengths of beginnings
BEGINNINGS = (3, 4, 5, 6)


@dataclass
class Link:
    """One classifier of the chain: the words it looks at and its weights for them, earlier probabilities and 1."""

    words: np.ndarray
    weights: np.ndarray


def presence(sets: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    x = np.zeros((len(sets), len(words)))
    if len(words):
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        spot = np.minimum(np.searchsorted(words, flat), len(words) - 1)
        hit = words[spot] == flat
        x[np.repeat(np.arange(len(sets)), size)[hit], spot[hit]] = 1
    return x


@dataclass
class Counted:
    """Words of all texts, and for each word of each text its number and the text's."""

    words: np.ndarray
    at: np.ndarray
    row: np.ndarray

    @staticmethod
    def of(sets: list[np.ndarray]) -> Counted:
        words, at = np.unique(np.concatenate(sets), return_inverse=True)
        return Counted(words, at, np.repeat(np.arange(len(sets)), [len(s) for s in sets]))


def telling_words(counted: Counted, taken: np.ndarray, y: np.ndarray, most: int = 128, least_z: float = 4.0) -> np.ndarray:
    """Words that, in the texts taken, stand in positive ones far more often than chance and text length explain."""
    inside = taken[counted.row]
    at, label = counted.at[inside], y[counted.row[inside]]
    positive, total = np.bincount(at, label, len(counted.words)), np.bincount(at, minlength=len(counted.words))
    # longer texts have more words: the share of positive text, by words
    share = max(label.mean() if len(label) else 0, 1e-9)
    z = (positive - total * share) / np.sqrt(total * share * (1 - share) + 1.0)
    fine = np.flatnonzero((z >= least_z) & (positive >= 5) & (2 * positive >= total))
    return np.sort(counted.words[fine[np.argsort(-z[fine], kind="stable")[:most]]])


def fit_link(sets: list[np.ndarray], counted: Counted, taken: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> Link:
    """A classifier fitted to the texts taken."""
    words, rows = telling_words(counted, taken, y), np.flatnonzero(taken)
    return Link(words, fit_logistic(np.column_stack([presence([sets[i] for i in rows], words), earlier[rows]]), y[rows], ridge=0.5))


def apply_link(link: Link, sets: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
    return predict_logistic(np.column_stack([presence(sets, link.words), earlier]), link.weights)


def train_chain(texts: list[bytes], toxic: np.ndarray, folds: int = 5) -> list[Link] | None:
    """The chain's classifiers in order; None without both labels.

    Near copies of a text in the sample count once.  What a later classifier sees of an earlier one in training is out of fold, as that is what it will be
    worth on unseen text.
    """
    if len(set(toxic.tolist())) < 2:
        return None
    keep = without_copies(texts)
    texts, toxic = [texts[i] for i in keep], toxic[keep]
    sets = word_sets(texts)
    counted, everything = Counted.of(sets), np.ones(len(sets), bool)
    seeds = {c: word_sets([" ".join(ws).encode()])[0] for c, ws in SEEDS.items()}
    fold = np.arange(len(texts)) % folds
    earlier = np.zeros((len(texts), 0))
    chain = []
    for category in CATEGORIES:
        y = toxic if category == "toxic" else (presence(sets, seeds[category]).any(axis=1)).astype(np.int64)
        chain.append(fit_link(sets, counted, everything, earlier, y))
        out = np.zeros(len(texts))
        for f in range(folds):
            inside = np.flatnonzero(fold == f)
            link = fit_link(sets, counted, fold != f, earlier, y)
            out[inside] = apply_link(link, [sets[i] for i in inside], earlier[inside])
        earlier = np.column_stack([earlier, out])
    return chain


def score_chain(chain: list[Link] | None, texts: list[bytes]) -> np.ndarray:
    """A column per category."""
    if chain is None:
        return np.zeros((len(texts), len(CATEGORIES)))
    sets = word_sets(texts)
    earlier = np.zeros((len(texts), 0))
    for link in chain:
        earlier = np.column_stack([earlier, apply_link(link, sets, earlier)])
    return earlier


def detect_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 6000, threshold: float = 0.5, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per document: id, p_insult, p_contempt, p_disgust, score (of toxic), toxic (score >= threshold).

    The chain is fitted to at most max_rows labelled rows of max_bytes together; all texts are scored, and a
    row's words are its whole text's.  Null and empty texts get the probabilities of a text without words.  Without labels of both kinds all are 0.  Other columns
    are left out.
    """
    chain = docs.sparkSession.sparkContext.broadcast(train_chain(*labelled_sample(docs, labels, "toxic", max_rows, id_col, text_col, max_bytes=max_bytes)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.concatenate([np.zeros((0, len(CATEGORIES))), *(score_chain(chain.value, texts) for _, _, texts in text_pieces(batch.column("text")))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.float64()) for c in p.T)], ["id", *(f"p_{c}" for c in SEEDS), "score"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = source.mapInArrow(score, "id long, " + ", ".join(f"p_{c} double" for c in SEEDS) + ", score double")
    return scored.withColumn("toxic", F.col("score") >= threshold).withColumnRenamed("id", id_col)
