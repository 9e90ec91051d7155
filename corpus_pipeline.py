"""The corpus pipeline: each stage's documents are written as Parquet and read again by the next.

Stages: the quality classifier rejects documents; the n-gram Jaccard join leaves one document of each group; suffix-array
dedup cuts repeated passages out of the texts of all but their first document; benchmark decontamination drops documents
that overlap with an item; SentencePiece appends the ids of each text (token_ids, n_tokens) and whether they decode to
the text again (round_trip).

Defined results: a null, empty or blank text is rejected by the classifier, unless no labels are there to fit it, then it goes
through all stages (its ids are null or none); documents without doc_id are judged by all stages but never dropped as copies
nor cut; of rows that repeat a doc_id one stays; of equal documents that of lowest doc_id stays; texts of any length are taken
whole; a passage that is cut leaves the rest of its document; further columns pass through, whatever their names, but those
that the last stage appends, which it replaces; an empty table of documents gives an empty result, one of labels or of the
benchmark rejects nothing.

Between stages the rows lie in the shared folder of spark.checkpoint.dir; the last stage's files are the result's own and stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, near_duplicates, quality_classifier, sentencepiece, suffix_dedup
from tessera.plans.lineage import shared_folder
from tessera.plans.ship import ship
from tessera.plans.spread import spread


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality_classifier.kept(spread(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def leave_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_duplicates.one_of_each_group(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return suffix_dedup.without_repeats(docs)


def leave_out_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return sentencepiece.encode_checked(docs)


STAGES = [
    ("quality classifier", reject_bad),
    ("n-gram Jaccard join", leave_one_of_each_group),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", leave_out_benchmark),
    ("SentencePiece encoding and decoding", tokens),
]

#: A trained classifier, MinHash candidates and suffix sorting can't be expressed in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    home = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{home}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/{k - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
