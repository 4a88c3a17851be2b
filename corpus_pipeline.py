"""From raw documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import minhash, packing, quality_classifier, quality_rules, substring
from corvane.llm.tables import read, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the calibrated classifier reject go."""
    model = quality_rules.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return quality_rules.good_documents(docs.select(COLUMNS), model)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low score go.

    The classifier learns from the raw table: the stage before has already taken
    away most rows of the label that it has to know.
    """
    model = quality_classifier.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~quality_classifier.held_out())
    return quality_classifier.good_documents(docs.select(COLUMNS), model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated units go; n_chars follows the text."""
    return substring.drop_repeated_units(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: The classifiers and the packing heuristic can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(COLUMNS)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
