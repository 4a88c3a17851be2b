"""Bounded, repeatable samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_labelled(documents: DataFrame, labels: DataFrame, target: str, rows_per_class: int, allowed: Column | None = None) -> DataFrame:
    """At most ``rows_per_class`` documents of each class 0 and 1, in the order of a hash of the id.

    Returns doc_id, text, label and weight, the number of labelled rows that each
    sampled row stands for.  Labels other than 0 and 1 and rows without an id are
    left out; of repeated labels of an id the smallest counts.
    """
    known = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(target).cast("int").alias("label"))
    if allowed is not None:
        known = known.where(allowed)
    present = documents.where(F.col("doc_id").isNotNull()).select("doc_id").join(known, "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in present.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for label in (0, 1):
        part = present.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class)
        part = part.withColumn("weight", F.lit(sizes.get(label, 0) / max(1, min(rows_per_class, sizes.get(label, 0)))))
        chosen = part if chosen is None else chosen.unionByName(part)
    # 2 * rows_per_class ids at most
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"), F.first("weight").alias("weight"))
