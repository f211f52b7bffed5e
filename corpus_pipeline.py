"""Corpus pipeline: quality, near-duplicates, repeated passages, benchmark contamination, source mix.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.  All columns of
documents go through, whatever they are; the last stage adds the mix, in place of columns with its
names.  Different texts of one id are documents of their own.  Documents without an id go through as
well: none is a near-duplicate, and in passages they count as the last ones.  Null and empty texts are
documents like others: the quality score decides on them, they have no near-duplicates, no passages and
no contamination, and the mix takes no words of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelyard.llm.compression_quality import quality_model, score_quality
from pixelyard.llm.decontamination import contamination, find_contamination
from pixelyard.llm.mixing import mix_sources
from pixelyard.llm.near_duplicates import near_duplicates
from pixelyard.llm.phrase_automata import phrase_dedup
from pixelyard.llm.shared import remove, shared_folder

MIX = ("size", "source_size", "target", "taken")


def unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs, in their order: those in `changed` from there, the id, and the others from the struct `rest`."""
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("doc_id") if c == "doc_id" else F.col(f"rest.`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more."""
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")), F.lit(0).alias("_"))
    scored = score_quality(docs.select("doc_id", "text", rest.alias("rest")), model).where("predicted = 1")
    return unpacked(scored, docs, text=F.col("text"))


def repeats_ids(docs: DataFrame) -> bool:
    """Whether doc_id doesn't tell all rows apart: an id twice, or none."""
    return docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count() > 0


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the smallest id of each component; of rows with one id and text, one.

    Of such rows the one whose other columns come first as JSON stays.  All different texts of an id stay or go
    together.  Documents without an id stay.
    """
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    left = docs.join(kept, "doc_id", "left_semi")
    if repeats_ids(docs):
        others = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
        place = F.row_number().over(Window.partitionBy("doc_id", F.sha2("text", 256)).orderBy(others))
        left = left.withColumn("_place", place).where("_place = 1").drop("_place").unionByName(docs.where("doc_id is null"))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 13-word passages that start in a document with a smaller id too.

    A text that loses none stays as it is; what is left of others is joined by spaces, and n_chars is its length.
    A document that loses all of its words goes.
    """
    done = phrase_dedup(docs, carry=True).where("n_removed = 0 or n_removed < n_units")
    changed = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("rest.n_chars"))
    return unpacked(done, docs, **changed)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less than a twentieth of whose words stand in windows of the benchmark."""
    found = contamination(find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=True))
    return unpacked(found.where("not contaminated"), docs, text=F.col("text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the mix's size, source_size, target and taken (words taken, repeats counted)."""
    docs = docs.drop(*MIX)
    if repeats_ids(docs):
        mixed = mix_sources(docs, carry=True)
        return mixed.select("doc_id", *(F.col(f"rest.`{c}`") for c in docs.columns if c != "doc_id"), *MIX)
    return docs.join(mix_sources(docs), "doc_id")


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("passages", passages),
    ("decontaminate", decontaminate),
    ("mix", mix),
]
#: the first stage is a trained classifier, which SQL can't express; tests hold all stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
