"""Byte and word repeats against brute force, with nulls, copies, overlaps and odd bytes."""

import hashlib
import random
import re

import numpy as np
import pytest

from pixelyard.llm.phrase_automata import phrase_dedup
from pixelyard.llm.repeats import first_least
from pixelyard.llm.suffix_array import maximal_repeats, suffix_array_dedup

WORDS = ["the", "of", "and", "naïve", "x", "Straße", "re-do", "tion", "a b", "…"]


def corpus(seed, n=40):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    shared = [text(rng.randint(8, 40)) for _ in range(6)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.1:
            rows.append((i * 3, rng.choice([None, "", "  \n", "x"])))
        elif kind < 0.3 and rows:
            rows.append((i * 3, rng.choice(rows)[1]))
        else:
            rows.append((i * 3, rng.choice([" ", "\n\t "]).join([text(rng.randint(0, 30)), rng.choice(shared), text(rng.randint(0, 20)), rng.choice(shared)])))
    rows.append((rows[5][0], rows[6][1]))  # an id twice
    rows.append((None, rows[7][1]))
    rows += [(10_000, "ab" * 60), (10_001, "ba" * 40), (10_002, "\x00" * 70), (10_003, "\x00" * 55)]
    rng.shuffle(rows)
    return rows


def brute(rows, window, units, sep):
    big = 1 << 62
    first = {}
    docs = [(big if i is None else i, units(t)) for i, t in rows]
    for i, u in docs:
        for p in range(len(u) - window + 1):
            key = sep.join(u[p : p + window])
            first[key] = min(first.get(key, big), i)
    out = []
    for (i, u), (real, _) in zip(docs, rows):
        gone = [False] * len(u)
        for p in range(len(u) - window + 1):
            if first[sep.join(u[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = sep.join(x for x, g in zip(u, gone) if not g)
        out.append((real, len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def as_bytes(t):
    t = (t or "").encode()
    return [t[i : i + 1] for i in range(len(t))]


def as_words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(t, i, 1, "s") for i, t in rows], "text string, doc_id long, chunk int, id string").repartition(5)
    for op, window, units, sep in ((suffix_array_dedup, 50, as_bytes, b""), (phrase_dedup, 13, as_words, b" ")):
        got = op(docs, chunk_bytes=1500, bucket_bytes=900).select("doc_id", "n_units", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows, window, units, sep)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_array_dedup(docs).count() == 0
    assert phrase_dedup(docs).count() == 0


def test_maximal_repeats():
    texts = [b"xabcdefy", b"zabcdefw", b"abcdef", b"qabcq"]
    found = dict(maximal_repeats(texts, 3))
    assert found == {b"abcdef": [(0, 1), (1, 1), (2, 0)], b"abc": [(0, 1), (1, 1), (2, 0), (3, 1)]}
    # no repeat may be lengthened at all places alike, and all places are listed
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(5)]
    found = dict(maximal_repeats(texts, 4))
    strings = {t[i:j] for t in texts for i in range(len(t)) for j in range(i + 4, len(t) + 1)}
    for s in strings:
        places = [(k, i) for k, t in enumerate(texts) for i in range(len(t)) if t.startswith(s, i)]
        before = {texts[k][i - 1 : i] or k for k, i in places} if all(i for _, i in places) else {0, 1}
        after = {texts[k][i + len(s) : i + len(s) + 1] for k, i in places}
        maximal = len(places) > 1 and len(before) > 1 and (len(after) > 1 or b"" in after)
        assert (s in found) == maximal, s
        if maximal:
            assert found[s] == places


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_with_equal_polynomial_hashes(spark):
    one, two = thue_morse(1024)
    start = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{start} {one}"), (2, f"{start} {two}"), (3, f"{start} {one}")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in phrase_dedup(docs).collect()} == {1: 0, 2: 0, 3: 13}


def test_places_of_least():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, 200).astype(np.uint64)
    for width in (1, 2, 5, 8, 27):
        assert first_least(x, width).tolist() == [i + int(np.argmin(x[i : i + width])) for i in range(len(x) - width + 1)]


def test_one_anchor_in_many_contents(spark):
    """A phrase in thousands of documents, with other words before and after it in each."""
    rng = random.Random(8)
    phrase = " ".join(f"p{i}" for i in range(9))
    rows = [(i, " ".join([f"a{rng.randrange(3000)}", f"b{rng.randrange(40)}", phrase, f"c{rng.randrange(40)}", f"d{rng.randrange(3000)}", f"e{i % 7}"])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = phrase_dedup(docs, chunk_bytes=20_000, bucket_bytes=10_000).select("doc_id", "n_units", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 13, as_words, b" ")
