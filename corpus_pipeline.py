"""A corpus from raw documents to shards, stage by stage.

Each stage reads what its predecessor wrote as Parquet and works on all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodfeed.llm import decontaminate, langid, mixture, near, shards
from moodfeed.llm.arrow import unused
from moodfeed.llm.queries import SHARD_DIMENSIONS
from moodfeed.staging import stage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID, learnt from the documents' own labels; documents without a language go."""
    name = unused(docs, "predicted")
    predicted = langid.identify(docs, langid.train(docs), name)
    return predicted.where(F.col(f"{name}.lang_pred") != langid.UNKNOWN).select(*docs.columns)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the smallest id."""
    return near.keep_first(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    name = unused(docs, "verdict")
    judged = decontaminate.decontaminate(docs, benchmark, name)
    return judged.where(~F.col(f"{name}.contaminated")).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their weights: a row for each time that a document is taken."""
    name, turn = unused(docs, "mixed"), unused(docs, "turn")
    mixed = mixture.mix(docs, name)
    copies = F.array_repeat(F.lit(0), F.col(f"{name}.copies").cast("int"))
    return mixed.withColumn(turn, F.explode(copies)).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard."""
    name = unused(docs, "shard")
    return shards.kd_shards(docs, SHARD_DIMENSIONS[1:], name, shards.SHARDS)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", distinct_texts),
    ("decontaminate", clean_of_benchmark),
    ("mix", mixed_sources),
    ("shard", sharded),
]

#: Fitted models and alignments have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
