"""Top-k inner products, source mixing and decontamination against brute force."""

import hashlib
import math
import random
import re

import pytest

from pixelyard.llm.decontamination import contamination, find_contamination
from pixelyard.llm.inner_products import top_inner_products
from pixelyard.llm.mixing import mix_sources


def test_top_inner_products(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) * rng.choice([1, 1, 3]) for _ in range(16)]) for i in range(300)]
    rows += [(500 + i, rows[20][1]) for i in range(30)]  # ties
    rows += [(40, rows[7][1]), (40, rows[40][1]), (700, None), (701, [1.0, None]), (702, [float("nan")] * 16), (703, [float("inf")] * 16), (None, [0.5] * 16), (704, [])]
    docs = spark.createDataFrame([(v, i, 5) for i, v in rows], "embedding array<float>, vec_id long, block int").repartition(4)
    got = sorted(tuple(r) for r in top_inner_products(docs, lambda i: i % 20 == 0, shard_rows=100, query_rows=7, lead=4).collect())
    held = {(r["vec_id"], tuple(r["embedding"])) for r in docs.where("vec_id is not null and size(embedding) = 16").collect()}
    clean = [(i, [math.floor(64 * x) for x in v]) for i, v in held if all(math.isfinite(x) for x in v)]
    n40 = sum(r[0] == 40 for r in rows)
    clean += [c for c in clean if c[0] == 40 and sum(c == d for d in clean) == 1 and [math.floor(64 * x) for x in rows[40][1]] != c[1]][:0]
    clean = [(i, v) for i, v in clean] + [next(c for c in clean if c[0] == 40 and c[1] == clean_40(docs))] * (n40 - sum(c[0] == 40 for c in clean))
    want = []
    for n, (i, v) in enumerate(clean):
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(clean) if m != n)[:20]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    assert got == sorted(want)


def clean_40(docs):
    """The vector that id 40 has twice."""
    vs = [tuple(math.floor(64 * x) for x in r["embedding"]) for r in docs.where("vec_id = 40").collect()]
    return list(max(vs, key=vs.count))


def test_top_of_huge_components(spark):
    """Scores never wrap: components beyond the bound count as the bound."""
    rows = [(0, [1e30, 1.0]), (1, [1e30, -1e30]), (2, [-1e300, 2.0]), (3, [0.5, 0.5])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    most = math.isqrt((2**63 - 1) // 2)
    whole = {i: [max(-most, min(most, math.floor(64 * x))) for x in v] for i, v in rows}
    want = sorted((0, i, sum(a * b for a, b in zip(whole[0], whole[i]))) for i in (1, 2, 3))
    got = [tuple(r) for r in top_inner_products(docs, lambda i: i % 20 == 0).select("query_id", "vec_id", "score").collect()]
    assert sorted(got) == want and all(abs(x) < 2**63 for *_, x in want)


def test_top_of_few_and_none(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_inner_products(none, lambda i: i % 20 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 9.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_inner_products(two, lambda i: i % 20 == 0).collect()] == [(0, 1, 1, 64 * 32)]


def brute_mix(rows, weights=(5, 2, 1), epochs=3):
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    names = sorted({s for _, s, _ in sized}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, t, n in sized if t == s) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, list(names), sum(size.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * share > epochs * size[s]]
        if not over:
            target |= {s: weight[s] * share for s in open_}
            break
        for s in over:
            target[s] = epochs * size[s]
            left -= target[s]
            open_.remove(s)
    total, copies = sum(size.values()), []
    for s in names:
        reached = 0
        for key, i, n in sorted((hashlib.md5(f"1:{'' if i is None else i}".encode()).hexdigest(), -1 if i is None else i, n) for i, t, n in sized if t == s):
            reached += n
            copies += [((e * size[s] + reached) / target[s], names.index(s), key, i, n) for e in range(epochs) if n]
    taken, reached = {}, 0
    for _, s, key, i, n in sorted(copies):
        reached += n
        if reached > total:
            break
        taken[s, i] = taken.get((s, i), 0) + n
    return target, size, taken, sized, names


@pytest.mark.parametrize("hot", [False, True])
def test_mix_sources(spark, hot):
    rng = random.Random(4)
    rows = [(i, rng.choice(["", None, "a b\tc"]) if rng.random() < 0.1 else "w " * rng.randint(1, 60), "big" if hot and rng.random() < 0.7 else rng.choice(["a", "é", "z", "Z", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as target").repartition(5)
    got = mix_sources(docs).collect()
    target, size, taken, sized, names = brute_mix(rows)
    assert len(got) == len(rows)
    of = {i: (s, n) for i, s, n in sized}
    for r in got:
        s, n = of[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, size[s])
        assert r["target"] == pytest.approx(target[s], rel=1e-12)
        assert r["taken"] == taken.get((names.index(s), r["doc_id"]), 0) <= 3 * n
    for s in names:
        assert abs(sum(r["taken"] for r in got if of[r["doc_id"]][0] == s) - target[s]) <= 61


def test_mix_of_nothing(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    blank = spark.createDataFrame([(1, None, None), (None, " ", "a")], "doc_id long, text string, source string")
    assert sorted((tuple(r) for r in mix_sources(blank).collect()), key=repr) == [(1, 0, 0, 0.0, 0), (None, 0, 0, 0.0, 0)]


def test_decontamination(spark):
    rng = random.Random(8)
    words = ["the", "Of", "naïve", "x9", "Straße", "K", "K", "42", "and", "to"]  # the kelvin sign isn't a k
    text = lambda k: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n- ", "…" if rng.random() < 0.1 else " "]) for _ in range(k))
    items = [(i, text(rng.choice([1, 3, 12, 13, 14, 30]))) for i in range(12)] + [(50, None), (51, " !"), (None, text(20)), (3, text(15))]
    docs = []
    for i in range(80):
        body = text(rng.randint(0, 90))
        if rng.random() < 0.5:
            body += rng.choice(items)[1] or ""
        docs.append((i, body.upper() if rng.random() < 0.3 else body + text(rng.randint(0, 30))))
    docs += [(100, None), (101, ""), docs[3]]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    want = []
    for i, t in docs:
        w = split(t)
        hit, found = set(), set()
        for item, x in items:
            v = split(x)
            n = min(13, len(v))
            for p in range(len(v) - n + 1) if n and item is not None else ():
                for q in range(len(w) - n + 1):
                    if w[q : q + n] == v[p : p + n]:
                        hit.update(range(q, q + n))
                        found.add(str(item))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want.append((i, len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    left = spark.createDataFrame([(t, i, 0) for i, t in docs], "text string, doc_id long, item int").repartition(3)
    right = spark.createDataFrame(items, "item_id long, text string")
    for block, once in ((1 << 20, 1 << 20), (40, 1 << 20), (40, 90)):
        got = contamination(find_contamination(left, right, block_bytes=block, pass_bytes=once)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
        assert sorted(map(tuple, got)) == sorted(want)
    empty = contamination(find_contamination(left, right.limit(0)))
    assert empty.where("n_hit > 0 or contaminated").count() == 0 and empty.count() == len(docs)
    assert find_contamination(left.limit(0), right).count() == 0


def test_contamination_takes_a_mebibyte_of_text_at_a_time(spark, monkeypatch):
    import pyarrow as pa
    from pyspark.sql.classic.dataframe import DataFrame

    taken = []
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, search, schema, *_: taken.append(search) or spark.createDataFrame([], schema))
    words = " ".join(f"w{i}" for i in range(13))
    find_contamination(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("a", words)], "item_id string, text string"))
    texts = [f"{words} {'x y ' * 7500}" for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], ["id", "text"])
    parts = list(taken[0](iter([batch])))
    assert [i for p in parts for i in p["id"].to_pylist()] == list(range(200)) and all(h == [[0, 13]] for p in parts for h in p["hits"].to_pylist())
    assert max(sum(len(texts[i]) for i in p["id"].to_pylist()) for p in parts) <= 1 << 20
