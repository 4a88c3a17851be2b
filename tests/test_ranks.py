"""Quantiles, row numbers and scans that split hot keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import ranks as K
from corvane.operators import revisions as R
from corvane.plans import inputs as I
from corvane.plans.catalog import QUERIES


@pytest.mark.parametrize("bins,few", [(64, 3), (1024, 1000)])
def test_quantiles_by_force(spark, bins, few):
    r = random.Random(bins)
    shares = [0.0, 0.1, 0.5, 0.6, 0.95, 0.99, 1.0]
    kinds = {
        "normal": [r.gauss(0, 1) for _ in range(400)], "wide": [10.0 ** r.randint(-300, 300) * r.choice([-1, 1]) for _ in range(99)], "ties": [r.choice([1.0, 2.0]) for _ in range(300)],
        "one": [7.25], "two": [1.0, 4.0], "same": [3.0] * 50, "ends": [-1.7e308, 1.7e308, 0.0, 5.0], "near": [1.0 + k * 2**-52 for k in range(40)], "infinite": [float("inf"), 1.0, 2.0, -float("inf"), 3.0],
    }
    rows = [(k, v) for k, vs in kinds.items() for v in vs] + [("normal", None), ("none", None), ("same", float("nan"))]
    r.shuffle(rows)
    got = {x["key"]: x for x in K.exact_quantiles(spark.createDataFrame(rows, "kind string, x double").repartition(3), "x", shares, "kind", bins, few).collect()}
    assert set(got) == set(kinds)
    for kind, values in kinds.items():
        x = got[kind]
        assert (x["n"], x["low"], x["high"]) == (len(values), min(values), max(values))
        if kind == "infinite":
            assert x["quantiles"][2] == 2.0
            continue
        s = sorted(values)
        for share, q in zip(shares, x["quantiles"], strict=True):
            place = share * (len(s) - 1)
            a, z = s[int(np.floor(place))], s[int(np.ceil(place))]
            assert q == a + (z - a) * (place - np.floor(place))


def test_quantiles_of_nothing(spark):
    assert K.exact_quantiles(spark.createDataFrame([], "x double"), "x", [0.5]).count() == 0
    assert K.exact_quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]).count() == 0


def test_no_percentile_in_the_plans(spark, data):
    for name in ("g6_variance_profile", "m3_latency_profile"):
        assert "percentile" not in QUERIES[name](spark, data)._jdf.queryExecution().toString()


@pytest.mark.parametrize("span", [7, 10**6])
def test_row_numbers_of_hot_keys(spark, span):
    r = random.Random(span)
    rows = [("hot", r.randint(0, 50), k) for k in range(200)] + [(f"k{r.randint(0, 9)}", r.randint(-5, 5), k) for k in range(60)] + [(None, 4, 1), (None, 3, 2), ("hot", None, 9999)]
    df = spark.createDataFrame(rows, "key string, at long, tie long").repartition(4)
    got = K.number_rows(df, ["key"], ["at", "tie"], "n", span)
    assert got.columns == ["key", "at", "tie", "n"]
    found = {(x["key"], x["at"], x["tie"]): x["n"] for x in got.collect()}
    for key in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == key), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        assert [found[x] for x in own] == list(range(1, len(own) + 1))
    assert K.number_rows(df.limit(0), ["key"], ["at"], "n", span).count() == 0
    with pytest.raises(ValueError):
        K.number_rows(df, ["at"], ["key"])


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date"])
def test_row_numbers_by_times(spark, kind):
    """Ranges of times, those before 1970 and those of an hour that a zone skips or repeats included."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        texts = [f"2024-03-10 0{h}:{m}:00.25" for h in (1, 2, 3) for m in (10, 40)] + [f"2024-11-03 0{h}:{m}:00.5" for h in (0, 1, 2) for m in (10, 40)] + ["1969-12-31 23:59:59.25", "1969-12-31 23:59:59.75", "1970-01-01 00:00:00.5", "0001-01-03 00:00:00", None]
        rows = [(k % 2, t, k) for k, t in enumerate(texts * 3)]
        df = spark.createDataFrame(rows, "key int, at string, tie int").withColumn("at", F.col("at").cast(kind)).repartition(3)
        one = sorted(map(repr, K.number_rows(df, ["key"], ["at", "tie"], "n").collect()))
        assert sorted(map(repr, K.number_rows(df, ["key"], ["at", "tie"], "n", 4).collect())) == one
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("span", [1, 10, 10**6])
def test_scan_of_a_hot_id_in_ranges(spark, span):
    r = random.Random(span)
    log = [("hot", n, [float(n), 1.0]) for n in range(1, 120)] + [(f"N{k}", n, [float(k), float(n)]) for k in range(8) for n in sorted(r.sample(range(1, 60), 5))] + [("one", 1, [0.0, 0.0]), ("null", 1, None), ("null", 5, [1.0, 1.0])]
    got = {(x["id"], x["seq"]): x["previous"] for x in R.with_previous(spark.createDataFrame(log, "id string, seq long, vector array<double>").repartition(3), span).collect()}
    want, last = {}, {}
    for i, n, v in sorted(log, key=lambda x: (x[0], x[1])):
        want[i, n] = last.get(i)
        last[i] = v
    assert got == want


def test_trajectories_of_one_single_label(spark, data, tmp_path, monkeypatch):
    """K1, K2, K15 and V8 are the same whether the one hot id is scanned whole or by ranges, and tasks stay small."""
    spark.read.parquet(f"{data}/embeddings.parquet").withColumn("label", F.lit(1)).write.parquet(f"{tmp_path}/embeddings.parquet")
    names = ("k1_finite_difference", "k2_kinetic_resistance", "k15_trend_check", "v8_ingest_vectors", "r11_previous_vector")
    whole = {n: sorted(map(repr, QUERIES[n](spark, str(tmp_path)).collect())) for n in names}
    monkeypatch.setattr(K, "SPAN", 40)
    for f, place in ((K.number_rows, -1), (K.range_of, -1), (K.with_last, -1), (R.with_previous, -1)):
        monkeypatch.setattr(f, "__defaults__", (*f.__defaults__[:place], 40))
    assert {n: sorted(map(repr, QUERIES[n](spark, str(tmp_path)).collect())) for n in names} == whole
    log = I.vec_log(spark, str(tmp_path)).withColumn("part", F.floor((F.col("seq") - 1) / 40))
    assert log.groupBy("id", "part").count().agg(F.max("count")).first()[0] <= 40
    assert len(whole["k2_kinetic_resistance"]) == 500
