"""A corpus from raw documents to packed training sequences, stage by stage.

Each stage takes (spark, documents so far, folder of the tables) and returns a DataFrame, which is written as Parquet and read again
for the next stage. All but the last return the columns of ``documents``; rows a stage drops are gone for all that follow.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingloom.llm import mixing, neardup, packing, pii, quality
from pingloom.plans.stages import discard, noting
from pingloom.session import pin_session, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_kept: dict[str, list[str]] = {}  # by application: what the stage before wrote for itself


def tidy(stage: Stage) -> Stage:
    """A stage that deletes what the one before wrote for itself: that one's result is written by now, as this one reads it."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        discard(spark, _kept.pop(app, []))
        with noting() as paths:
            out = stage(spark, docs, sf_dir)
        _kept[app] = paths
        return out

    run_stage.__doc__ = stage.__doc__
    return run_stage


@tidy
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier doesn't reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@tidy
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id."""
    return neardup.distinct(docs)


@tidy
def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by the kind of each span; n_chars is the new text's."""
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


@tidy
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have their target shares of the words."""
    return mixing.sample(docs)


@tidy
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of at most 2048 tokens."""
    return packing.pack(docs, "text", ["doc_id"])


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", without_near_copies),
    ("PII", without_personal_data),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

# Hashed sampling and learned weights have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``, each written to the shared folder and read again."""
    pin_session(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.mode("errorifexists").parquet(path)
        docs = spark.read.parquet(path)
    return docs
