"""A corpus pipeline in five stages; each works on all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read again as the next one's ``docs``.
All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import language, minhash_dedup, packing, quality, suffix_dedup
from inkveil.llm.bloom import bloom_split
from inkveil.llm.common import documents, id_fold, materialize, remove, small_batches, stage_folder, written
from inkveil.llm.queries import labels, vocabulary

#: Least share of a document's words that its language must have.
LANGUAGE_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, null texts among them, and those in which no language holds half the words.

    Where no row has both text and language, so that nothing can be learned, all documents
    stay.  Each row is judged by its text alone: repeated rows stay or go together.  An
    empty table stays empty.
    """
    small_batches(spark)
    model = language.fit_on_documents(docs, id_fold(F.col("doc_id"), 5) != 0)
    if not model.languages:
        return docs
    said = language.predict(F.col("text"), model)
    return docs.filter(said["score"] >= LANGUAGE_SHARE)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is under ``quality.KEEP``; a null text is scored as an empty one.

    Where the labels hold no two classes, so that nothing can be learned, all documents
    stay.  Repeated rows stay or go together.  An empty table stays empty.
    """
    small_batches(spark)
    model = quality.fit_on_labels(docs, labels(spark, sf_dir), id_fold(F.col("doc_id"), 4) != 2)
    if not model.learned:
        return docs
    return docs.filter(quality.score(F.col("text"), model) >= quality.KEEP)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest identifier of each group of near copies.

    Rows with a null identifier are in no group and all stay, as do null, empty and blank
    texts, which have no words.  Rows that repeat a kept identifier stay, but of those
    equal in identifier and text one.  An empty table stays empty.
    """
    small_batches(spark)
    found = minhash_dedup.near_duplicates(docs).filter("doc_id is not null").groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n"))
    # few identifiers go or are repeated; the others' texts stay where they are, without a shuffle
    odd = materialize(found.filter("not kept or n > 1"), "odd-ids")
    perhaps, others = bloom_split(docs, "doc_id", odd, "doc_id")
    once = perhaps.join(odd, "doc_id", "left_anti").select(*docs.columns)
    again = perhaps.join(odd.filter("kept").select("doc_id"), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return others.unionByName(once).unionByName(again)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated byte strings out of the texts; a text that loses all goes.

    ``n_chars``, if there is one, is counted again.  Null and empty texts stay as they
    are; of repeated rows the first keeps its text.  An empty table stays empty.
    """
    small_batches(spark)
    out = suffix_dedup.without_repeats(docs)
    if "n_chars" in out.columns:
        kind = out.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences; null and empty texts are their end id alone."""
    small_batches(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("repeat_removal", repeat_removal),
    ("packing", pack),
]

#: Classifiers and branch and bound are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's table is written to the shared folder; what a stage made on its way goes with the stage."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        with stage_folder(spark) as outer:
            path = f"{outer}/pipeline-{name}-{uuid.uuid4().hex}"
            docs = written(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        before = path
    return docs
