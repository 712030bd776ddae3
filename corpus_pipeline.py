"""From raw documents to token ids: five stages, each over all that the one before it kept.

documents may have nulls in any column, empty and very long texts, repeated rows and further columns, which
all stages but the last pass on; an empty table gives an empty one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from waymark.llm import decontamination, entries, ngram_join, pieces, quality, toxicity
from waymark.llm.common import small_batches, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic. It learns from two thirds of the labels.

    A row is judged by its text alone: null and empty texts score as a text without features, repeated
    rows go or stay together. Without usable labels all rows have one score."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(entries.id_remainder(3) != 1)
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def drop_repetitive(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep.

    Null and empty texts have fewer words than the rules ask for and go; repeated rows go or stay together."""
    small_batches(spark)
    return quality.kept(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near copies: five-word shingles, similarity 0.8 or more.

    Rows equal in id and text are one; rows with a null id can't be named by a group and stay, and so do
    rows without words, which are like nothing."""
    small_batches(spark)
    return ngram_join.representatives(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    A verdict is of an id and a text, so rows of one id with other texts, and of null ids, are judged by
    their own; null and empty texts hold nothing and stay; an empty benchmark takes nothing away."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and piece ids of each document that is left, a row for each row; null and empty texts have no pieces."""
    small_batches(spark)
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_repetitive),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode),
]

#: A classifier and merges of pieces are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
