"""License scan: phrases against brute force, notices with changes, edge cases."""

import random
import re

from pixelyard.llm.licences import NOTICES, PHRASES, scan_licences


def test_phrases_against_brute_force(spark):
    rng = random.Random(6)
    words = ["cc", "by", "CC", "general", "Public", "license", "all", "Rights", "reserved", "é", "x9"]
    docs = [(i, "".join(rng.choice(words) + rng.choice([" ", "-", "\n", ", ", "…"] if rng.random() < 0.2 else [" "]) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "..."), (103, "cc by cc by"), (103, "cc by cc by"), (None, "all rights reserved"), (104, "ALL RIGHTS RESERVED " * 3000)]
    want = []
    for i, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        places = [(p, label) for phrase, label in PHRASES.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        starts = [p for p, _ in places]
        want.append((i, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    left = spark.createDataFrame([(t, i, "x") for i, t in docs], "text string, doc_id long, label string").repartition(3)
    got = scan_licences(left).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"]) for r in got)


def test_notices(spark):
    mit = next(iter(NOTICES))
    w = mit.split()
    docs = [(1, "Hello. " + mit.upper()), (2, " ".join(w[:8] + ["really"] + w[9:])), (3, " ".join(w[:6])), (4, " ".join(w[::-1])), (5, "Released under the MIT License."), (6, " ".join(w[:10] + ["z"] * 40 + w[10:]))]
    got = {r["doc_id"]: r for r in scan_licences(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in range(1, 7)] == ["mit", "mit", "", "", "mit", ""]
    assert got[1]["score"] == 1.0 and 0.7 <= got[2]["score"] < 1 and got[1]["base_labels"] == ""
    assert scan_licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0
