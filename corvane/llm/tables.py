"""Reading the corpus tables, cutting lineage, and checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    A temporary one is set only where none is named and all runs on one machine, as in tests.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """Write the rows to the cluster's shared checkpoint folder and read them from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def keep_table(df: DataFrame) -> DataFrame:
    """As ``keep``, in columns: for larger results of which later steps read parts."""
    place = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(place)
    kept = df.sparkSession.read.schema(df.schema).parquet(place)
    kept.kept_in = place
    return kept


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``keep_table`` that no later step reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.kept_in)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, each finished job's shuffle files go at once: results that are read again are tables by then."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """Let Arrow batches to and from Python hold at most 16 MB from now on in this session.

    Rows with two texts each would otherwise fill 64 MB on either side of the pipe.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


#: Ids that a filter sends to every executor; beyond, both sides are shuffled.
BROADCAST_IDS = 2_000_000


def with_ids(df: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows whose id is among the ids, which must already be written or cheap to count."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, column, "left_semi")


def lower_ascii(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
