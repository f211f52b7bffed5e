"""The pipeline's stages, each against brute force on its own input."""

import hashlib
import random
import re

import pytest

import corpus_pipeline
from pixelyard.llm.queries import QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    folder = tmp_path_factory.mktemp("tables")
    plain = [f"w{i}" for i in range(200)]
    text = lambda k: [rng.choice(plain) for _ in range(k)]
    items = [(i, " ".join(text(20))) for i in range(4)]
    passage = text(30)
    docs, labels = [], []
    for i in range(240):
        words, good = text(rng.randint(40, 90)), 1
        if i % 8 == 1:
            words, good = ["@@!!", "$$$"] * rng.randint(20, 40), 0
        elif i % 8 == 2:
            words = words[:20] + passage + words[20:]
        elif i % 8 == 3:
            words = words[:30] + items[i % 4][1].split()
        elif i % 8 == 4 and i > 8:
            words = docs[i - 4][1].split()
            words[5] = "changed"
        docs.append((i, " ".join(words), "en", f"s{i % 3}", len(" ".join(words))))
        labels.append((i, good, 0))
    docs += [docs[0], (900, None, None, None, None), (901, "", "en", "s1", 0), (None, "no id", "en", "s0", 5)]
    spark.createDataFrame(docs, SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_stages(spark, tables):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = {}
    for name in ("quality", "near_dedup", "passages", "decontaminate"):
        before = [r for r in docs.collect() if r["doc_id"] is not None]
        nameless = docs.where("doc_id is null").count()
        docs = stages[name](spark, docs, tables)
        assert docs.columns == list(COLUMNS)
        kept[name] = (before, {r["doc_id"]: r for r in docs.collect() if r["doc_id"] is not None})
        assert docs.where("doc_id is null").count() == nameless == 1
        docs = spark.createDataFrame(docs.collect(), SCHEMA)
    before, after = kept["quality"]
    plain = {r["doc_id"] for r in before if r["text"]}
    assert {i for i in after if i in plain} == {i for i in plain if i % 8 != 1 or i >= 900}

    before, after = kept["near_dedup"]
    sets = {r["doc_id"]: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for r in before for w in [words(r["text"])]}
    links = {x: [y for y in sets if y < x and sets[x] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])] for x in sets}
    assert set(after) == {x for x in sets if not links[x]} and any(links.values())

    before, after = kept["passages"]
    first = {}
    for r in before:
        w = words(r["text"])
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, 10**9), r["doc_id"])
    cut = 0
    for r in before:
        w = words(r["text"])
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < r["doc_id"]:
                gone[k : k + 13] = [True] * 13
        if any(gone):
            cut += 1
            left = " ".join(x for x, g in zip(w, gone) if not g)
            assert after[r["doc_id"]]["text"] == left and after[r["doc_id"]]["n_chars"] == len(left)
        else:
            assert after[r["doc_id"]]["text"] == r["text"]
    assert cut

    before, after = kept["decontaminate"]
    grams = {tuple(w[k : k + 13]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect() for w in [words(r["text"])] for k in range(len(w) - 12)}
    dirty = set()
    for r in before:
        w = words(r["text"])
        hit = {j for k in range(len(w) - 12) if tuple(w[k : k + 13]) in grams for j in range(k, k + 13)}
        if hit and 20 * len(hit) >= len(w):
            dirty.add(r["doc_id"])
    assert dirty and set(after) == {r["doc_id"] for r in before} - dirty

    mixed = [r for r in stages["mix"](spark, docs, tables).collect()]
    assert {r["doc_id"] for r in mixed} == {*after, None}
    sizes = {}
    for r in mixed:
        assert r["size"] == len(words(r["text"]))
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    target = shared_out(sizes)
    queue = []
    for r in mixed:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
    for source in sizes:
        key = lambda r: hashlib.md5(f"1:{r['doc_id']}".encode() if r["doc_id"] is not None else f"1:{hashlib.md5((r['text'] or '').encode()).hexdigest()}".encode()).hexdigest()
        upto = 0
        for r in sorted((r for r in mixed if r["source"] == source), key=key):
            upto += r["size"]
            queue += [((copy * sizes[source] + upto) / target[source], r) for copy in range(3) if r["size"]]
    queue.sort(key=lambda x: x[0])
    left, taken = sum(sizes.values()), {}
    for _, r in queue:
        if r["size"] > left:
            break
        left -= r["size"]
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["size"]
    assert {r["doc_id"]: r["taken"] for r in mixed} == {r["doc_id"]: taken.get(r["doc_id"], 0) for r in mixed}


def shared_out(sizes):
    """Targets by weight, capped at three times a source's size."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.discard(s)


def test_other_columns_go_through(spark, tables):
    """Columns with names that operators use themselves, and of other types."""
    schema = f"{SCHEMA}, score double, size long, rest string, id int, tags map<string,int>"
    rng = random.Random(14)
    rows = [(i, " ".join(f"v{rng.randrange(5000)}" for _ in range(50)), "en", f"s{i % 2}", i, i / 2, i + 1, f"r{i}", i, {"k": i}) for i in range(6)]
    given = docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, tables)
        same = [c for c in given.columns if name != "mix" or c != "size"]
        assert sorted(map(repr, docs.select(*same).collect())) == sorted(map(repr, given.select(*same).collect()))
        assert name == "mix" or docs.columns == given.columns


def test_run(spark, tables):
    assert corpus_pipeline.run(spark, tables).where("taken > 0").count() > 0
    assert len([q for q in QUERIES if re.match(r"op\d+_", q)]) == 10


def test_different_texts_of_one_id(spark, tables):
    rng = random.Random(13)
    text = lambda k: " ".join(f"v{rng.randrange(5000)}" for _ in range(k))
    one, two, three = text(40), text(60), text(50)
    rows = [(1, one, "en", "b", 1), (1, one, "en", "a", 1), (1, two, "de", "a", 2), (2, three, "en", "a", 3), (3, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    by_all = lambda rs: sorted(map(tuple, rs), key=repr)
    docs = stages["near_dedup"](spark, docs, tables)
    assert by_all(docs.collect()) == by_all(rows[1:])
    mixed = stages["mix"](spark, docs, tables)
    assert by_all(mixed.select(*COLUMNS).collect()) == by_all(rows[1:])
    assert all(r["size"] == len(words(r["text"])) and r["source_size"] == 150 for r in mixed.collect())
    for name in ("passages", "decontaminate"):
        docs = stages[name](spark, docs, tables)
        assert by_all((r["doc_id"], r["text"] or None) for r in docs.collect()) == by_all(r[:2] for r in rows[1:])
