"""Near-duplicate components against all pairs."""

import random
import re

import numpy as np
import pytest

from pixelyard.llm import near_duplicates as near
from pixelyard.llm.near_duplicates import components, fast_sketch, near_duplicates, shingle_sets
from pixelyard.llm.shared import Scratch


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["Été", "ÉTÉ"]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    bases = [text(rng.randint(30, 120)) for _ in range(8)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.06:
            rows.append((i, rng.choice([None, "", " \n", "a b", "A  B"])))
        elif kind < 0.2:
            rows.append((i, " ".join(text(rng.randint(1, 60)))))
        else:
            copy = list(rng.choice(bases))
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((i, rng.choice([" ", "\t"]).join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
    rows.append(rows[50])
    rng.shuffle(rows)
    return rows


def brute(rows):
    sets = {}
    for i, t in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i, _ in rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(t, i, "x", 0) for i, t in rows], "text string, doc_id long, rep string, n int").repartition(3)
    assert sorted(map(tuple, near_duplicates(docs).collect())) == brute(rows)


def test_empty_and_null(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).count() == 0
    docs = spark.createDataFrame([(None, "a b c"), (None, None), (4, "a b c"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(docs).collect()), key=repr) == [(3, 0, 3, True), (4, 1, 4, True), (None, 0, None, True), (None, 1, None, True)]


@pytest.mark.parametrize("few", [10, 100_000])
def test_components(spark, monkeypatch, few):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(55)] + [(100 + k, 101 + k) for k in range(40)]
    monkeypatch.setattr(near, "FEW", few)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long").repartition(5), Scratch(spark)).df.collect()))
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(root) if find(x) != x}


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(1, 2**63, 900, dtype=np.uint64)
    a, b = np.sort(pool[:600]), np.sort(pool[100:700])  # similarity 5/7
    sketch = fast_sketch([a, b, pool[:1], np.zeros(0, np.uint64)], 128)
    assert (sketch[:3] != np.uint64(2**64 - 1)).all()
    assert abs((sketch[0] == sketch[1]).mean() - 5 / 7) < 0.15
    assert len(shingle_sets([b"", b"a b", b"a b c d e f"], 5)[2]) == 2


def test_crowd_around_the_threshold(spark):
    """Many copies of one text, a good part of them just below or above the threshold to the original and to each other."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        copy = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 4, 4, 5, 5, 6])):
            copy[at] = rng.choice([f"v{k}" for k in range(6)])
        if rng.random() < 0.3:
            del copy[rng.randrange(100) :][: rng.randint(1, 12)]
        rows.append((i, " ".join(copy)))
    for i in range(160, 190):  # copies of copies far from the original
        copy = rows[rng.randrange(100, 160)][1].split()
        copy[rng.randrange(len(copy))] = "x"
        rows.append((i, " ".join(copy)))
    rng.shuffle(rows)
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows) and len({r[2] for r in got}) > 3


def test_texts_with_equal_polynomial_hashes(spark):
    bits = [0]
    while len(bits) < 1024:
        bits += [1 - b for b in bits]
    rows = [(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits))]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(1, 1, 1, True), (2, 1, 2, True)]


def test_id_with_several_texts(spark):
    """Rows of one id are one node: what is linked with one of its texts is linked with all."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(3, text("a")), (5, text("a")), (5, text("b")), (7, text("b") + " x"), (9, text("c"))]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert [(i, c) for i, _, c, _ in got] == [(3, 3), (5, 3), (5, 3), (7, 3), (9, 9)]


def test_copies_of_a_copy_in_a_crowd(spark, monkeypatch):
    """Two crowds that share a part: one around a text, one around a distant copy of it; more than may be broadcast."""
    from pixelyard.llm import shared

    rng = random.Random(12)
    base = [f"w{k}" for k in range(100)]
    far = base[:70] + [f"z{k}" for k in range(30)]
    rows = []
    for i in range(150):
        copy = list(base if i % 2 else far)
        for at in rng.sample(range(100), rng.choice([0, 1, 1, 2])):
            copy[at] = f"u{rng.randrange(9)}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sorted(map(tuple, near_duplicates(docs).collect())) == want
    monkeypatch.setattr(shared, "FEW", 20)
    monkeypatch.setattr(near, "FEW", 20)
    monkeypatch.setattr(near, "SLICE", 7)
    assert sorted(map(tuple, near_duplicates(docs).collect())) == want


def test_recall_just_above_the_threshold():
    """Share of pairs at 0.75 to 0.80 that agree in a band: 1 - (1 - 0.75**4)**32, or 0.999995, is the least expected."""
    rng = np.random.default_rng(5)
    found = tried = 0
    for _ in range(400):
        n = int(rng.integers(40, 400))
        pool = rng.integers(1, 2**63, 2 * n, dtype=np.uint64)
        apart = int(n * 0.139)  # similarity about (n - apart) / (n + apart)
        a, b = pool[:n], pool[apart : n + apart]
        if not 0.75 <= (n - apart) / (n + apart) <= 0.8:
            continue
        one, two = near.band_hashes(fast_sketch([np.sort(a), np.sort(b)], 128), 4)
        tried += 1
        found += bool((one == two).any())
    assert tried > 250 and found == tried
