"""Streams in several micro-batches, with late rows, repeated batches and expiry."""

import datetime
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import revisions as R
from corvane.operators import vectors as O
from corvane.plans import inputs as I
from corvane.streaming import jobs as T


def stream_of(spark, place, schema, batches):
    """A stream that takes one of the batches at a time."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(place)
    return spark.readStream.option("maxFilesPerTrigger", 1).schema(spark.read.parquet(place).schema).parquet(place)


def test_a_batch_that_runs_twice_adds_nothing(spark, data, tmp_path):
    batch = I.bad_vectors(spark, data).select("vec_id", "vector")
    write = T.ingest_batches(I.axes(spark, data), 64, F.lit(True))(str(tmp_path))
    write(batch.where("vec_id < 200"), 0)
    write(batch.where("vec_id >= 200"), 1)
    read = lambda: [sorted(map(repr, spark.read.parquet(f"{tmp_path}/{t}").collect())) for t in ("log", "dead")]
    first = read()
    write(batch.where("vec_id >= 200"), 1)
    write(batch.where("vec_id < 200"), 0)
    assert read() == first
    rejected = I.bad_vectors(spark, data).withColumn("reason", O.vector_reject_reason(F.col("vector"), 64)).where("reason is not null")
    dead = spark.read.parquet(f"{tmp_path}/dead")
    assert {(r["vec_id"], r["projections"]) for r in dead.collect()} == {(r["vec_id"], f'{{"error":"{r["reason"]}"}}') for r in rejected.collect()}
    assert len(first[0]) + len(first[1]) == 500 and dead.select("batch").distinct().count() == 2
    write(batch.limit(0), 2)
    assert read() == first


BATCHES = [
    [("a", 5), ("a", 3), ("b", 4), ("a", 9)] + [("hot", 100 + k) for k in range(500)],
    [("a", 1), ("c", 20), ("b", 21), ("c", 19)] + [("hot", 50 - k % 3) for k in range(20)],  # ids that come late
    [("c", 30), ("d", 31), (None, 40), (None, 41), ("b", 2)],
]


def test_dedupe_in_three_batches(spark, tmp_path):
    stream = stream_of(spark, f"{tmp_path}/in", "idempotency_key string, ingestion_id long", BATCHES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # a key's rows come in parts
    try:
        place = T.run(T.dedupe_stream(stream), "dedupe", conf=T.ROCKSDB)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = sorted((r["ingestion_id"], r["first_id"], r["duplicate"]) for r in spark.read.parquet(f"{place}/rows").collect())
    known: dict = {}
    want = []
    for rows in BATCHES:
        for key in {k for k, _ in rows}:
            known.setdefault(key, min(i for k, i in rows if k == key))
        want += [(i, known[k], i != known[k]) for k, i in rows]
    assert got == sorted(want)


def test_dedupe_by_whole_batches(spark, tmp_path):
    """The same rows as by a state for each key, with no Python for each of them, also where a batch runs again."""
    schema = "idempotency_key string, ingestion_id long"
    write = T.first_batches(4)(str(tmp_path))
    for n in (0, 1, 1, 2, 3):
        write(spark.createDataFrame(BATCHES[n] if n < 3 else [], schema), n)
    known: dict = {}
    want = []
    for rows in BATCHES:
        for key in {k for k, _ in rows}:
            known.setdefault(key, min(i for k, i in rows if k == key))
        want += [(i, known[k], i != known[k]) for k, i in rows]
    found = spark.read.parquet(f"{tmp_path}/rows")
    assert sorted((r["ingestion_id"], r["first_id"], r["duplicate"]) for r in found.collect()) == sorted(want)


def test_keys_are_forgotten_by_timers(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    batches = [[("a", 1, at(0)), ("b", 2, at(0))], [("a", 3, at(30)), ("c", 4, at(100))], [("d", 5, at(101))], [("a", 6, at(102)), ("c", 7, at(103))]]
    stream = stream_of(spark, f"{tmp_path}/in", "idempotency_key string, ingestion_id long, ts timestamp", batches)
    place = T.run(T.dedupe_stream(stream, 50), "dedupe", conf=T.ROCKSDB)
    got = {r["ingestion_id"]: (r["first_id"], r["duplicate"]) for r in spark.read.parquet(f"{place}/rows").collect()}
    assert got == {1: (1, False), 2: (2, False), 3: (1, True), 4: (4, False), 5: (5, False), 6: (6, False), 7: (4, True)}


def test_trajectories_in_three_batches(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = [(f"N{k % 4}", k, [float(v) for v in r.normal(size=3)], float(r.random())) for k in range(60)]
    late = [x for x in rows if x[1] % 11 == 0]
    on_time = [x for x in rows if x[1] % 11]
    batches = [on_time[:20], on_time[20:40] + late[:3], on_time[40:] + late[3:]]
    stream = stream_of(spark, f"{tmp_path}/in", "id string, vec_id long, vector array<double>, variance double", batches)
    place = T.run(T.kinetics_stream(stream), "kinetics", conf=T.ROCKSDB)
    got = {(x["id"], x["vec_id"]): (x["seq"], x["k_cin"]) for x in spark.read.parquet(f"{place}/rows").collect()}
    arrived = [(x[0], n, x[1], x[2], x[3]) for n, b in enumerate(batches) for x in b]
    assert len(got) == 60
    for i in {x[0] for x in rows}:
        own = sorted(x for x in arrived if x[0] == i)
        log = spark.createDataFrame([(i, k + 1, x[2], x[3], x[4]) for k, x in enumerate(own)], "id string, seq long, vec_id long, vector array<double>, variance double")
        for x in R.kinetics(log).collect():
            seq, k = got[i, x["vec_id"]]
            assert seq == x["seq"] and (k is None or np.isnan(k)) == (x["k_cin"] is None) and (x["k_cin"] is None or k == pytest.approx(x["k_cin"], abs=1e-12))


def test_current_state_after_each_of_three_batches(spark, data, tmp_path):
    log = I.node_log(spark, data).select("id", "seq", "state").cache()
    parts = [log.where("seq % 3 = 1 and id < 'NODE_12'"), log.where("seq % 3 = 0"), log.where("seq % 3 = 2 or seq % 3 = 1")]  # older revisions come late
    write = T.merge_batches(8)(str(tmp_path))
    seen, hidden = None, "state <> 'telemetry_error'"
    for n, part in enumerate([*parts, parts[2]]):
        n = min(n, 2)  # the last batch runs again
        write(part, n)
        seen = part if seen is None else seen.unionByName(part).distinct()
        got = T.merged_state(spark, str(tmp_path)).select("id", "seq", "state")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, R.latest(seen).collect()))
        assert sorted(map(tuple, got.where(hidden).collect())) == sorted(map(tuple, R.current_nodes(seen).collect()))
    one = log.limit(1).withColumn("seq", F.lit(10**6).cast("long"))
    write(one, 3)
    assert len([x for x in os.listdir(f"{tmp_path}/state/version=3") if x.startswith("bucket=")]) == 1  # only the touched bucket
    write(one.limit(0), 4)
    assert T.merged_state(spark, str(tmp_path)).where("seq = 1000000").count() == 1
    assert T.merged_state(spark, f"{tmp_path}/nothing") is None
