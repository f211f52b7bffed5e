"""License scan by diagonal voting, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: fixed values: phrases and their labels; every place where a phrase's words stand consecutively counts
PHRASES: dict[str, str] = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: fixed values: openings of public licence notices and their labels; a notice may be reworded in part
NOTICES: dict[str, str] = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu": "gpl",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this work is licensed under a creative commons attribution": "cc-by",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
}


def template_rows() -> list[tuple]:
    """template, label, phrase, words, at, one, two: each pair of neighbouring words of each phrase and notice."""
    rows = []
    for number, (text, label) in enumerate([*PHRASES.items(), *NOTICES.items()]):
        words = text.split()
        rows += [(number, label, number < len(PHRASES), len(words), at, words[at], words[at + 1]) for at in range(len(words) - 1)]
    return rows


def templates(docs: DataFrame) -> DataFrame:
    """template_rows as a fixed, small table, with the hash of each pair."""
    table = docs.sparkSession.createDataFrame(template_rows(), "template int, label string, phrase boolean, words int, at int, one string, two string")
    return table.withColumn("gram", F.xxhash64("one", "two"))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = 0.7, drift: int = 2) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    All pairs of neighbouring words of all texts are joined by hash, and then by the words themselves, to
    the positions of the templates' pairs.  A match votes for its diagonal, the place in the text minus
    the place in the template.  A phrase stands on each diagonal that has all of its votes.  For notices,
    diagonals no further apart than `drift` are merged, as inserted or dropped words shift the rest, and
    the span is verified: it has to hold `coverage` of the notice's pairs, in not more than half as many
    words again.

    n_base counts the phrases' places, first_word and last_word are the smallest and largest (from 0; null
    without any), labels joins both kinds, sorted, by commas, and score is the largest share of a found
    template's pairs.  Null and empty texts have no words, no labels and score 0.  Repeated rows each get
    their result.  Lower-casing is Unicode's, which turns nothing but the Kelvin sign into a letter of the
    templates.  Other columns are left out.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text, F.length(text)).alias("digest"), text.alias("text"))
    words = F.split(F.regexp_replace(F.lower("text"), f"^{SEPARATORS}", ""), SEPARATORS)
    neighbours = rows.where("text is not null").select("id", "digest", words.alias("w")).where("size(w) > 1")
    zipped = F.arrays_zip(F.col("w").alias("one"), F.expr("slice(w, 2, size(w))").alias("two"))
    grams = neighbours.select("id", "digest", F.posexplode(zipped).alias("place", "g")).select("id", "digest", "place", F.col("g.one").alias("one"), F.col("g.two").alias("two"))
    grams = grams.withColumn("gram", F.xxhash64("one", "two"))
    votes = grams.join(F.broadcast(templates(docs)), ["gram", "one", "two"]).withColumn("diagonal", F.col("place") - F.col("at"))
    lines = votes.groupBy("id", "digest", "template", "label", "phrase", "words", "diagonal").agg(F.collect_set("at").alias("ats"), F.min("place").alias("low"), F.max("place").alias("high"))

    base = lines.where(F.col("phrase") & (F.size("ats") == F.col("words") - 1)).select("id", "digest", "label", F.col("diagonal").alias("start"), F.lit(True).alias("base"), F.lit(1.0).alias("share"))

    along = Window.partitionBy("id", "digest", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > drift).cast("int"), F.lit(1))
    merged = lines.where(~F.col("phrase")).withColumn("apart", apart).withColumn("island", F.sum("apart").over(along))
    spans = merged.groupBy("id", "digest", "template", "label", "words", "island").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("hits"), F.min("low").alias("low"), F.max("high").alias("high"))
    share = F.col("hits") / (F.col("words") - 1)
    notices = spans.where((share >= coverage) & (F.col("high") + 2 - F.col("low") <= 1.5 * F.col("words") + 1)).select("id", "digest", "label", F.col("low").cast("int").alias("start"), F.lit(False).alias("base"), share.alias("share"))

    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = base.unionByName(notices).groupBy(F.col("id").alias("of"), F.col("digest").alias("by")).agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        listed(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        listed("label").alias("labels"),
        F.max("share").alias("score"),
    )
    counted = rows.select("id", "digest", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("n_words"))
    joined = counted.join(found, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("by")), "left")
    return joined.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
