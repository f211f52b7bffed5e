"""Compression quality and the toxicity chain: held-out accuracy, edge cases, chained features."""

import math
import random
import zlib

import numpy as np
import zstandard

from pixelyard.llm.compression_quality import BLOCK, quality_model, score_quality, train_quality
from pixelyard.llm.labelled import labelled_sample
from pixelyard.llm.toxicity import CATEGORIES, detect_toxicity, score_chain, train_chain, without_copies

PLAIN = ["river", "house", "walks", "under", "slowly", "green", "carry", "window", "stone", "and", "the", "of"]
JUNK = ["@@", "##", "$$$", "CLICK", "!!!", "FREE", ">>", "%%"]


def corpus(n=400):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        words = [rng.choice(PLAIN if good or rng.random() < 0.5 else JUNK) for _ in range(rng.randint(30, 120))]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "trash", "scum"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def test_quality(spark):
    docs, labels = corpus()
    extra = [(1000, None), (1001, ""), (1002, "word " * 30_000)]
    left = spark.createDataFrame([(t, i, 0.1) for i, t in docs + extra], "text string, doc_id long, score double").repartition(3)
    right = spark.createDataFrame(labels + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in score_quality(left, quality_model(left, right)).collect()}
    assert len(got) == len(docs) + 3 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    held = [(i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i]["score"] >= 0.5) == bool(q) for i, q in held]) > 0.95
    assert got[1000]["score"] == got[1001]["score"]


def test_quality_without_labels(spark):
    left = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_model(left, none) is None and train_quality([b"a", b"b"], np.array([1, 1])) is None
    assert [tuple(r) for r in score_quality(left, None).collect()] == [(1, "a", 0.5, 1)]
    assert score_quality(left.limit(0), None).count() == 0


def test_quality_reads_long_texts_to_their_end():
    docs, labels = corpus()
    model = train_quality([t.encode() for _, t in docs], np.array([q for _, q, _ in labels]))
    rng = random.Random(4)
    start, good, bad = (" ".join(rng.choices(kind, k=700_000)).encode()[: n * BLOCK] for kind, n in ((PLAIN + JUNK, 12 << 10), (PLAIN, 2 << 10), (JUNK, 2 << 10)))
    assert len(start) == 3 << 20
    # what a text adds to the difference of the sizes does not depend on how much stands before it
    difference = lambda t: round(model.measures([t])[0, 0] * len(t))
    for text in (good, bad):
        assert difference(start + text) - difference(start) == difference(text) != 0
    # nor does the score on how often a text stands there
    assert np.allclose(model.score([good, good * 8, bad, bad * 8]), np.repeat(model.score([good, bad]), 2))


def test_quality_scores_by_hand():
    """The score of each text from zstandard's own sizes of its blocks and the model's weights."""
    docs, labels = corpus()
    texts = [t.encode() for _, t in docs]
    model = train_quality(texts, np.array([q for _, q, _ in labels]))
    kind = zstandard.DICT_TYPE_FULLDICT if model.trained else zstandard.DICT_TYPE_RAWCONTENT

    def size(data, text):
        total = 0
        while text:
            block, text = text[:256], text[256:]
            total += len(zstandard.ZstdCompressor(3, zstandard.ZstdCompressionDict(data, dict_type=kind), write_content_size=False, write_dict_id=False).compress(block)) - 6
        return total

    for text in [*texts[:40], b"", b"x", b"again " * 500]:
        b, g, n = size(model.bad, text), size(model.good, text), max(1, len(text))
        x = ((b - g) / n, math.log(min(max((min(b, g) or n) / n, 1 / 64), 1 / 4)))
        z = sum(w * (v - m) / s for w, v, m, s in zip(model.weights, x, model.mean, model.scale)) + model.weights[-1]
        assert abs(model.score([text])[0] - 1 / (1 + math.exp(-z))) < 1e-9


def test_quality_of_other_vocabulary():
    """Clean text in words that no labelled text has isn't taken for junk, and labels on copies do little harm."""
    docs, labels = corpus()
    rng = random.Random(6)
    copied = "the river walks under the green stone and the house of the window slowly " * 4
    texts = [t.encode() for _, t in docs] + [(copied + " x" * (i % 3)).encode() for i in range(60)]
    model = train_quality(texts, np.array([q for _, q, _ in labels] + [0] * 60))
    words = ["".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    other = [" ".join(rng.choices(words, k=rng.randint(40, 200))).encode() for _ in range(50)]
    assert (model.score(other) >= 0.3).mean() > 0.95 and model.score([copied.encode()])[0] >= 0.3


def test_toxicity(spark):
    docs, labels = corpus()
    left = spark.createDataFrame([(t, i) for i, t in docs[:300] + [(1000, None), (1001, "")]] + [("You are a SCUM of the river", 1002)], "text string, doc_id long")
    known = spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in detect_toxicity(left, known).collect()}
    assert np.mean([got[i]["toxic"] == bool(t) for i, _, t in labels[200:300]]) > 0.9
    assert got[1002]["toxic"] and not got[1000]["toxic"] and got[1000]["score"] == got[1001]["score"]
    assert detect_toxicity(left, known.limit(0)).where("toxic").count() == 0
    assert detect_toxicity(left.limit(0), known).count() == 0


def test_chain_feeds_earlier_probabilities():
    docs, labels = corpus()
    chain = train_chain([t.encode() for _, t in docs], np.array([x for _, _, x in labels]))
    assert [len(link.weights) - len(link.words) - 1 for link in chain] == list(range(len(CATEGORIES)))
    p = score_chain(chain, [b"the river idiot", b"the river"])
    assert p.shape == (2, len(CATEGORIES)) and p[0, 0] > p[1, 0] and p[0, -1] > 0.5 > p[1, -1]
    assert without_copies([b"a b c d e f g", b"x", b"a b c d e f g", b""]).tolist() == [0, 1, 3]


def test_sample_of_bounded_size(spark):
    docs, labels = corpus(200)
    left = spark.createDataFrame(docs + [(0, "again"), (500, "unlabelled")], "doc_id long, text string")
    known = spark.createDataFrame(labels + [(i, 0, 0) for i in range(1000, 2000)], "doc_id long, quality int, toxic int")
    texts, found = labelled_sample(left, known, "quality", 150)
    # labels of documents that aren't there take no place in the sample
    assert len(texts) == 150 and labelled_sample(left, known, "quality", 150)[0] == texts
    some, _ = labelled_sample(left, known, "quality", 150, max_bytes=20_000)
    assert some and sum(map(len, some)) <= 20_000 and set(some) <= set(texts) and some[:20] == texts[:20]
    assert quality_model(left, known, max_bytes=0) is None and detect_toxicity(left, known, max_bytes=0).where("score > 0").count() == 0
