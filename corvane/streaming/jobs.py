"""Streaming forms of ingestion, deduplication, trajectories and current state."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import vectors as V
from ..operators import revisions as R
from ..operators import vectors as O
from ..plans import inputs as I
from ..sources.tables import shared_folder as folder

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Buckets of the current-state table, by a hash of the id.
BUCKETS = 64


def run(stream: DataFrame, name: str, mode: str = "append", each: Callable[[str], Callable[[DataFrame, int], None]] | None = None, conf: dict[str, str] | None = None) -> str:
    """Run a stream over what there is now; returns the folder of its tables (``rows``, or what ``each`` writes)."""
    spark = stream.sparkSession
    place = f"{folder(spark)}/{name}-{uuid.uuid4()}"
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    try:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        writer = stream.writeStream.option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).outputMode(mode)
        writer = writer.foreachBatch(each(place)) if each else writer.format("parquet").option("path", f"{place}/rows")
        writer.start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return place


def source(spark: SparkSession, d: str, name: str, view: DataFrame | None = None, files: int | None = None) -> DataFrame:
    """A table as a stream of its files, ``files`` of them in a batch; a derived view is written first."""
    reader = spark.readStream if files is None else spark.readStream.option("maxFilesPerTrigger", files)
    if view is not None:
        place = f"{folder(spark)}/{name}-{uuid.uuid4()}"
        view.write.parquet(place)
        return reader.schema(view.schema).parquet(place)
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return reader.schema(schema).option("pathGlobFilter", f"{name}.parquet*").parquet(d)


def appended(rows: DataFrame, table: str, batch: int) -> None:
    """The rows of a batch in a folder of its own: a batch that runs again writes the same rows in the same place."""
    rows.write.mode("overwrite").parquet(f"{table}/batch={batch}")


# --- ingestion -----------------------------------------------------------

def ingest_batches(axes: DataFrame, width: int, key: Column) -> Callable[[str], Callable[[DataFrame, int], None]]:
    """Two tables, ``log`` of gated vectors and ``dead`` of rejected ones with the reason, each row under its batch."""
    threshold = O.calibrate_threshold(axes)

    def each(place: str) -> Callable[[DataFrame, int], None]:
        def write(batch: DataFrame, number: int) -> None:
            checked = batch.withColumn("reason", O.vector_reject_reason(F.col("vector"), width)).persist()  # read twice
            good = O.vector_variances(checked.where("reason is null").withColumn("vector", V.unit(F.col("vector"))), axes, ["vec_id"])
            appended(O.evaluate_gate(good, threshold, key).select("vec_id", "variance", "state"), f"{place}/log", number)
            appended(O.to_error_log(checked.where("reason is not null").withColumn("ingestion_id", F.col("vec_id"))).withColumn("vec_id", F.expr("cast(substring(id, 5) as long)")), f"{place}/dead", number)
            checked.unpersist()

        return write

    return each


def ingest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Validate, project and gate a stream of vectors; rejected ones become error rows of a table of their own."""
    stream = source(spark, d, "vectors", I.bad_vectors(spark, d).select("vec_id", "vector"))
    place = run(stream, "ingest", each=ingest_batches(I.axes(spark, d), 64, F.col("vec_id") % 3 != 0))
    log, dead = spark.read.parquet(f"{place}/log"), spark.read.parquet(f"{place}/dead")
    return log.select("vec_id", "state").unionByName(dead.select("vec_id", F.col("lifecycle_state").alias("state")))


# --- deduplication -------------------------------------------------------

class FirstOfKey(StatefulProcessor):
    """The first id of a key, as a value in the state store.

    A batch's rows come in parts; their ids wait in a list of the state store until
    all are seen, so that memory holds one part whatever a key's number of rows.
    ``seconds``: a timer forgets the key so long after its first row's time.
    """

    def __init__(self, seconds: int | None = None):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "id long")
        self.waiting = handle.getListState("waiting", "id long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        least, since = None, None
        for part in rows:
            ids = part["ingestion_id"]
            self.waiting.appendList([(int(x),) for x in ids])
            least = int(ids.min()) if least is None else min(least, int(ids.min()))
            if self.seconds is not None:
                time = int(part["ts"].min().timestamp() * 1000)
                since = time if since is None else min(since, time)
        if not self.first.exists():
            self.first.update((least,))
            if self.seconds is not None:
                self.handle.registerTimer(since + 1000 * self.seconds)
        known, held = self.first.get()[0], []
        for (one,) in self.waiting.get():
            held.append(one)
            if len(held) == 10_000:
                yield self.marked(held, known)
                held = []
        self.waiting.clear()
        yield self.marked(held, known)

    @staticmethod
    def marked(ids: list[int], first: int) -> pd.DataFrame:
        return pd.DataFrame({"ingestion_id": np.array(ids, dtype=np.int64), "first_id": np.full(len(ids), first, dtype=np.int64), "duplicate": np.array(ids, dtype=np.int64) != first})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.first.clear()
        yield self.marked([], 0)

    def close(self) -> None:
        pass


def dedupe_stream(stream: DataFrame, seconds: int | None = None) -> DataFrame:
    """Each row (idempotency_key, ingestion_id) with the first id of its key and whether it is another.

    First is the smallest id of the earliest batch that has the key.  With ``seconds``
    rows carry ``ts``, and a key is forgotten so long after its first row, once the
    watermark has passed; without, keys stay in the state store for ever.
    """
    if seconds is not None:
        stream = stream.withWatermark("ts", "0 seconds")
    mode = "None" if seconds is None else "EventTime"
    return stream.groupBy("idempotency_key").transformWithStateInPandas(FirstOfKey(seconds), "ingestion_id long, first_id long, duplicate boolean", "append", mode)


def first_batches(buckets: int = BUCKETS) -> Callable[[str], Callable[[DataFrame, int], None]]:
    """Rows as ``dedupe_stream`` gives them without ``seconds``, in ``rows`` under their batch; first ids in ``state``, a table of buckets by the key's hash.

    Whole batches are grouped and joined, so that a key costs no call of its own.  A batch that
    runs again starts from the versions before it and writes the same.
    """

    def each(place: str) -> Callable[[DataFrame, int], None]:
        def write(batch: DataFrame, number: int) -> None:
            spark = batch.sparkSession
            bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
            new = batch.groupBy(F.col("idempotency_key").alias("id")).agg(F.min("ingestion_id").alias("first_id")).select("id", "first_id", bucket.alias("bucket"), F.lit(1).alias("age"))
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most the number of buckets
            if not touched:
                return
            old = merged_state(spark, place, number)
            both = new if old is None else new.unionByName(old.where(F.col("bucket").isin(touched)).select("id", "first_id", "bucket", F.lit(0).alias("age")))
            known = both.groupBy("id", "bucket").agg(F.min_by("first_id", "age").alias("first_id"))
            version = f"{place}/state/version={number}"
            known.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(version)
            rows = batch.join(spark.read.parquet(version).select("id", "first_id"), F.col("idempotency_key").eqNullSafe(F.col("id")))
            appended(rows.select("ingestion_id", "first_id", (F.col("ingestion_id") != F.col("first_id")).alias("duplicate")), f"{place}/rows", number)

        return write

    return each


def dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Each row of the queue with the first id of its key and whether that key was seen before."""
    stream = source(spark, d, "queue", I.queue(spark, d).select("idempotency_key", "ingestion_id"))
    return spark.read.parquet(run(stream, "dedupe", each=first_batches()) + "/rows").drop("batch")


# --- trajectories --------------------------------------------------------

class Steps(StatefulProcessor):
    """An id's last number and vector, as a value in the state store; rows are numbered as they come, one part at a time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, vector array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seq, last = self.last.get() if self.last.exists() else (0, None)
        last = None if last is None else np.asarray(last, dtype=float)
        for part in rows:
            part = part.sort_values("vec_id")
            x = np.stack(part["vector"].to_numpy())
            before = np.concatenate((x[:1] if last is None else last[None, :], x[:-1]))
            k = 0.5 * ((x - before) ** 2).sum(1) * (1 + part["variance"].to_numpy())
            if last is None:
                k[0] = np.nan
            yield pd.DataFrame({"id": key[0], "vec_id": part["vec_id"].to_numpy(), "seq": seq + 1 + np.arange(len(x)), "k_cin": k})
            seq, last = seq + len(x), x[-1]
        self.last.update((seq, [float(v) for v in last]))

    def close(self) -> None:
        pass


def kinetics_stream(projected: DataFrame) -> DataFrame:
    """id, vec_id, seq and k_cin of rows (id, vec_id, vector, variance); late rows get the next number.

    Within a part of a batch (an Arrow batch of one id) rows go by ``vec_id``.
    """
    return projected.groupBy("id").transformWithStateInPandas(Steps(), "id string, vec_id long, seq long, k_cin double", "append", "None")


def kinetics(spark: SparkSession, d: str) -> DataFrame:
    """Vectors are projected as they come; each id keeps its last number and vector."""
    stream = source(spark, d, "trajectories", I.vec_log(spark, d).select("id", "vec_id", "vector").repartition(1).sortWithinPartitions("vec_id"))
    projected = O.vector_variances(stream.withColumn("v", F.col("vector")), I.axes(spark, d), ["id", "vec_id", "v"]).withColumnRenamed("v", "vector")
    return spark.read.parquet(run(kinetics_stream(projected), "kinetics", conf=ROCKSDB) + "/rows").select("id", "seq", F.round("k_cin", 6).alias("k_cin"))


# --- current state -------------------------------------------------------

def merge_batches(buckets: int = BUCKETS) -> Callable[[str], Callable[[DataFrame, int], None]]:
    """Keeps the latest revision of each id in ``state``, a table of buckets by the id's hash.

    A batch rewrites only the buckets that its ids fall in, as a version of its own; a
    bucket's newest version counts.  A batch that runs again starts from the versions before it and writes the same.
    """

    def each(place: str) -> Callable[[DataFrame, int], None]:
        def write(batch: DataFrame, number: int) -> None:
            new = R.latest(batch).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most the number of buckets
            if not touched:
                return
            old = merged_state(batch.sparkSession, place, number)
            both = new if old is None else new.unionByName(old.where(F.col("bucket").isin(touched)))
            kept = R.latest(both)
            kept.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{place}/state/version={number}")

        return write

    return each


def merged_state(spark: SparkSession, place: str, before: int | None = None) -> DataFrame | None:
    """The newest version of each bucket (older than the batch ``before``), or None where there is none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/state")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    newest: dict[int, int] = {}
    for v in files.listStatus(root) if files.exists(root) else ():
        version = int(v.getPath().getName().split("=")[1])
        done = spark._jvm.org.apache.hadoop.fs.Path(v.getPath(), "_SUCCESS")
        if (before is None or version < before) and files.exists(done):
            for b in files.listStatus(v.getPath()):
                if b.getPath().getName().startswith("bucket="):
                    bucket = int(b.getPath().getName().split("=")[1])
                    newest[bucket] = max(version, newest.get(bucket, -1))
    if not newest:
        return None
    return spark.read.option("basePath", f"{place}/state").parquet(*[f"{place}/state/version={v}/bucket={b}" for b, v in sorted(newest.items())]).drop("version")


def current(spark: SparkSession, d: str) -> DataFrame:
    """Latest revision of each id, from a table that every batch is merged into."""
    stream = source(spark, d, "revisions", I.node_log(spark, d).select("id", "seq", "state"))
    return merged_state(spark, run(stream, "current", each=merge_batches())).select("id", "seq", "state")
