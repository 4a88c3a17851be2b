"""Sources and sinks: vectors, texts, the basis, the append-only log, reports."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import as_double

AXES = "axis_id string, symbol string, tag string, vector array<double>, epoch string"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; a temporary one where none is named and all runs on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def read_vectors(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(vec_id, label, vector) with float32 elements made double."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema) if stream else spark.read
    return reader.parquet(path).select("vec_id", "label", as_double(F.col("embedding")).alias("vector"))


def read_texts(spark: SparkSession, path: str, categories: dict[str, str], other: str) -> DataFrame:
    """(doc_id, category, text), the category given by the language."""
    category = F.lit(other)
    for lang, name in categories.items():
        category = F.when(F.col("lang") == lang, name).otherwise(category)
    return spark.read.parquet(path).select("doc_id", category.alias("category"), "text")


def write_axes(axes: DataFrame, path: str) -> None:
    """JSON rows of id, symbol, tag, vector and epoch; columns that are missing are null."""
    given = [F.col(c) if c in axes.columns else F.lit(None).cast("string").alias(c) for c in ("axis_id", "symbol", "tag", "vector", "epoch")]
    axes.select(*given).write.json(path)


def read_axes(spark: SparkSession, path: str, epoch: str) -> DataFrame:
    """The axes of one epoch in the order of their ids."""
    return spark.read.schema(AXES).json(path).where(F.col("epoch") == epoch).orderBy("axis_id")


def append_log(rows: DataFrame, path: str) -> None:
    """Rows are added and never changed; one writer at a time."""
    rows.write.mode("append").parquet(path)


def write_report(report: DataFrame, path: str) -> DataFrame:
    """Write a nested document as JSON and return it read back under its own strict schema."""
    report.write.json(path)
    return report.sparkSession.read.schema(report.schema).option("mode", "FAILFAST").json(path)
