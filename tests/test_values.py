"""Hand values and properties of operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import vectors as V
from corvane.operators import corpus as C
from corvane.operators import edges as E
from corvane.operators import revisions as R
from corvane.operators import screening as S
from corvane.operators import simplex
from corvane.operators import vectors as O


def basis(spark, k=8, d=384):
    rows = [(f"AXIS_{i + 1}", [1.0 if j == i else 0.0 for j in range(d)], "EPOCH_V1") for i in range(k)]
    return spark.createDataFrame(rows, "axis_id string, vector array<double>, epoch string")


def test_orthonormal_threshold_is_zero(spark):
    assert O.calibrate_threshold(basis(spark)).first()[0] == 0


def test_kinetic_resistance_by_hand(spark):
    unit = lambda i: [1.0 if j == i else 0.0 for j in range(384)]
    log = spark.createDataFrame([("a", 1, unit(1)), ("a", 2, unit(0))], "id string, seq long, vector array<double>")
    v = O.vector_variances(log.withColumn("own", F.col("vector")), basis(spark), ["id", "seq", "own"]).withColumnRenamed("own", "vector")
    got = {r["seq"]: r["k_cin"] for r in R.kinetics(v).collect()}
    assert got[1] is None and got[2] == pytest.approx(1.109375)


def test_ortho_distance_of_a_skew_basis(spark):
    rng = np.random.default_rng(8)
    b, x = rng.normal(size=(3, 6)), rng.normal(size=(20, 6))
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    axes = spark.createDataFrame([(f"AXIS_{i}", [float(v) for v in r]) for i, r in enumerate(b)], "axis_id string, vector array<double>")
    vecs = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k int, vector array<double>")
    got = {r["k"]: (r["ortho"], r["pp"]) for r in R.ortho_distance(O.with_spectrum(vecs, axes), ["k"]).collect()}
    for i, v in enumerate(x):
        assert got[i] == (pytest.approx(np.linalg.norm(v - b.T @ (b @ v)) ** 2), pytest.approx(np.linalg.norm(b @ v) ** 2))


def test_epoch_append(spark):
    after = O.append_epoch(basis(spark)).collect()
    assert len(after) == 9 and {len(r["vector"]) for r in after} == {385}


def test_gate_truth_table(spark):
    rng = np.random.default_rng(1)
    rows = [([float(x) for x in rng.normal(size=8)], t, key) for _ in range(60) for t in (0.0, 0.1, 0.5, 2.0) for key in (True, False)]
    df = spark.createDataFrame(rows, "v array<double>, t double, key boolean")
    for r in df.select("*", V.variance(F.col("v")).alias("var"), V.gate_state(F.map_from_arrays(F.transform("v", lambda x, i: i), "v"), F.col("t"), F.col("key")).alias("state")).collect():
        assert r["var"] == pytest.approx(np.var(r["v"]))
        assert r["state"] == ("consolidated" if r["key"] and np.var(r["v"]) >= r["t"] else "incubating")


def test_two_near_nodes_have_one_edge(spark):
    rows = [(n, [0.3 if j == i else 0.0 for j in range(384)]) for i, n in enumerate(("NODE_A", "NODE_B"))]
    edges = E.epsilon_edges(spark.createDataFrame(rows, "id string, vector array<double>"), 0.8).collect()
    assert [(e["source"], e["target"]) for e in edges] == [("NODE_A", "NODE_B")]


def test_block_count_does_not_change_edges(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(f"n{i:03d}", [float(x) for x in rng.normal(size=5)]) for i in range(60)], "id string, vector array<double>")
    sets = [{(r["source"], r["target"]) for r in E.epsilon_edges(df, 1.5, blocks=b).collect()} for b in (1, 4, 7)]
    assert sets[0] == sets[1] == sets[2] and sets[0]


def test_reduction(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 6)) * [5, 3, 2, 1, 1, 1]
    df = spark.createDataFrame([(str(i), [float(v) for v in r]) for i, r in enumerate(x)], "id string, vector array<double>")
    got = np.array([r["coords"] for r in E.svd_reduce(df).collect()])
    values = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert np.allclose(got.mean(0), 0, atol=1e-9) and np.allclose((got**2).sum(0), values[:2] ** 2)
    z = x / np.linalg.norm(x, axis=1, keepdims=True)
    m = z @ z.T - np.eye(50)
    w = np.linalg.eigvalsh(m)
    w = w[w > 1e-10]
    unit = df.withColumn("vector", V.unit(F.col("vector")))
    assert E.participation_ratio(unit) == pytest.approx(w.sum() ** 2 / (w**2).sum())


def test_simplices(spark):
    assert simplex.volume(np.array([[0.0, 0], [1, 0], [0, 1]])) == pytest.approx(0.5)
    df = spark.createDataFrame([(1, [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]], [0.25, 0.25])], "simplex_id long, vertices array<array<double>>, point array<double>")
    assert simplex.barycentric(df).first()["inside"]
    assert simplex.volumes(spark.createDataFrame([(1, [[0.0]])], "simplex_id long, vertices array<array<double>>")).first()["error"]


def test_recovery_of_json():
    assert S.recover('{"a": 1,}') == ('{"a": 1}', True)
    assert S.recover('x {"a": {"b": "}"}} y') == ('{"a": {"b": "}"}}', False)
    assert S.recover('{"a": 1')[1] and S.recover("nothing") == (None, False)
    assert S.recover('Here:\n```json\n{"a": [1, 2,], "b": {"c": 3,}\n```') == ('{"a": [1, 2], "b": {"c": 3}}', True)
    assert S.recover("{not valid json") == (None, False) and S.recover('{"a": "open') == (None, False)
    assert S.recover('{"a": "x, }"}') == ('{"a": "x, }"}', False)


def test_screening_decisions(spark):
    import json

    good = {"Intent_Class": "FIX", "Target_File": "a.txt", "Topological_Grounding": "known words", "Implementation_Block": "update", "Safety_Abort": "NONE"}
    text = lambda **k: json.dumps(good | k)
    cases = [
        (text(), "EXECUTE_SAFE"), (f"Sure:\n```json\n{text()}\n```\nDone.", "EXECUTE_SAFE"), (text()[:-1], "EXECUTE_SAFE"), (text()[:-1] + ",}", "EXECUTE_SAFE"), (f"see {text()} there", "EXECUTE_SAFE"),
        ("{not valid json", "INVALID_JSON"), ("plain", "INVALID_JSON"), (text(Safety_Abort="RISK_HIGH"), "BLOCKED_BY_SAFETY_GATE"), (text(Safety_Abort=None), "BLOCKED_BY_SAFETY_GATE"),
        (text(Implementation_Block="use curl here"), "ABORTED_VIOLATES_ZERO_TRUST"), (text(Topological_Grounding="other"), "ABORTED_GROUNDING_FAILED"), (text(Topological_Grounding=""), "ABORTED_GROUNDING_FAILED"),
        (text(Target_File="b.txt"), "ABORTED_GROUNDING_FAILED"), (text(Target_File="b.txt", Intent_Class="DOC"), "EXECUTE_SAFE"), (text(Implementation_Block="a\0b"), "ABORTED_VIOLATES_ZERO_TRUST"),
        (text(Implementation_Block="the escape \\u0000 itself"), "EXECUTE_SAFE"), (text() + "\0", "ABORTED_VIOLATES_ZERO_TRUST"), (text(Other="a\0b"), "ABORTED_VIOLATES_ZERO_TRUST"), ("[1, 2]", "ABORTED_GROUNDING_FAILED"),
        ('{"Intent_Class": "AUDIT"}', "ABORTED_GROUNDING_FAILED"), ("{}", "EXECUTE_SAFE"), (text(Implementation_Block=None), "ABORTED_GROUNDING_FAILED"),
    ]
    raw = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k long, raw string")
    files = spark.createDataFrame([("a.txt", b"some known words here")], "path string, content binary")
    got = {r["k"]: r["decision"] for r in S.screen_proposals(raw, files).collect()}
    assert got == {k: c[1] for k, c in enumerate(cases)}


def test_append_numbers(spark):
    log = spark.createDataFrame([("a", 1)], "id string, seq long")
    new = spark.createDataFrame([("a", 5), ("a", 4), ("b", 1)], "id string, at long")
    assert sorted((r["id"], r["at"], r["seq"]) for r in R.assign_seq(new, log, ["at"]).collect()) == [("a", 4, 2), ("a", 5, 3), ("b", 1, 1)]


def test_null_keys_never_collide(spark):
    q = spark.createDataFrame([(1, "k"), (2, "k"), (3, None), (4, None)], "ingestion_id long, idempotency_key string")
    assert {r["ingestion_id"]: r["duplicate"] for r in O.dedupe_idempotent(q).collect()} == {1: False, 2: True, 3: False, 4: False}


def test_compression_distance(spark):
    docs = spark.createDataFrame([(1, "abc " * 200), (2, "abc " * 200), (3, "".join(map(str, range(500))))], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    got = {(r["a"], r["b"]): r["ncd"] for r in C.ncd(pairs, docs).collect()}
    assert got[1, 2] < 0.3 < 0.7 < got[1, 3]


def test_distance_to_the_whole_reference(spark, monkeypatch):
    texts = [(i, f"text {i} é " * (i % 7 * 30)) for i in range(40)] + [(40, "a long one " * 900), (41, None), (42, "the last words of the reference")]
    table = spark.createDataFrame(texts, "item_id long, text string").repartition(3)
    whole = "\n".join(t for _, t in texts if t is not None).encode()
    docs = spark.createDataFrame([(1, "the last words of the reference " * 9), (1, "text 3 é"), (2, ""), (3, None), (4, "xyz " * 50)], "doc_id long, text string")
    size = C.CODECS["zlib"]
    for block in (1000, 1 << 20):
        monkeypatch.setattr(C, "HELD_BLOCKS", 5)
        monkeypatch.setattr(C, "HELD_TEXTS", 100)
        blocks = C.reference_blocks(table, "item_id", block)
        got = [bytes(r["reference"]) for r in blocks.orderBy("block").collect()]
        assert got == [whole[k : k + block] for k in range(0, len(whole), block)]
        near = sorted(((r["doc_id"], r["nearness"]) for r in C.ncd_to_reference(docs, blocks).collect()), key=lambda r: (r[0], r[1] or 0))
        want = []
        for r in docs.collect():
            if r["text"] is None:
                want.append((r["doc_id"], None))
                continue
            t = r["text"].encode()
            want.append((r["doc_id"], sum(len(b) * (1 - (size(t + b) - min(size(t), size(b))) / max(size(t), size(b))) for b in got) / len(whole)))
        for g, w in zip(near, sorted(want, key=lambda r: (r[0], r[1] or 0)), strict=True):
            assert g[0] == w[0] and (g[1] == w[1] or abs(g[1] - w[1]) < 1e-9)
    assert C.reference_blocks(table.limit(0), "item_id").collect()[0]["reference"] == b""


def test_copies_are_compared_once(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "calls")

    def size(b):
        with open(log, "a") as f:
            f.write("x\n")
        return 10 + len(b)

    monkeypatch.setitem(C.CODECS, "counted", size)
    docs = spark.createDataFrame([(k, f"text {k % 3}") for k in range(300)] + [(300, None), (300, None)], "doc_id long, text string")
    blocks = spark.createDataFrame([(0, b"one"), (1, b"two and")], "block long, reference binary")
    got = C.ncd_to_reference(docs, blocks, "counted").collect()
    assert sorted(r["doc_id"] for r in got) == [*range(300), 300, 300]
    assert {r["nearness"] is None for r in got if r["doc_id"] == 300} == {True}
    # each text by itself and before each block, and the blocks: before, 300 texts
    with open(log) as f:
        assert sum(1 for _ in f) <= 3 * 3 + 2 * 3


def test_sizes_from_a_kept_state():
    rng = np.random.default_rng(8)
    prose = lambda n: b" ".join(b"word%d" % w for w in rng.zipf(1.4, n) % 900)
    texts = [b"", b"a", prose(50), prose(3000), prose(9000), prose(30_000), rng.bytes(40_000), rng.bytes(70_000) + prose(4000), b"z" * 100_000, prose(5000) * 9]
    blocks = [b"", b"b", prose(2500), rng.bytes(1 << 14), b"z" * (1 << 14), texts[3][-9000:]]
    size = C.CODECS["zlib"]
    for t in texts:
        assert C.zlib_sizes(t, blocks) == (size(t), [size(t + b) for b in blocks])


def test_rank_test_without_a_side(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 2.0)], "category string, x double")
    r = C.mann_whitney(df, "x", F.col("category") == "A", F.col("category") == "B").first()
    assert (r["auc"], r["p"]) == (0.5, 1.0)


def test_rank_test_of_many_values(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(0.2, 1, 120_000), np.concatenate((rng.normal(0, 1, 100_000), np.full(500, 0.25)))
    df = spark.createDataFrame([(True, float(x)) for x in a] + [(False, float(x)) for x in b], "first boolean, x double").repartition(7)
    got = C.mann_whitney(df, "x", F.col("first"), ~F.col("first")).first()
    order = np.sort(b)
    auc = (np.searchsorted(order, a, "left") + np.searchsorted(order, a, "right")).sum() / 2 / (len(a) * len(b))
    assert got["auc"] == pytest.approx(auc, abs=1e-12)


def test_calibration_normalises_and_drops_zero_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 5)) * rng.uniform(0.1, 50, size=(40, 1))
    rows = [(f"n{i}", [float(v) for v in r]) for i, r in enumerate(x)] + [("zero", [0.0] * 5)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    distances = np.sort([np.linalg.norm(unit[i] - unit[j]) for i in range(40) for j in range(i)])
    df = spark.createDataFrame(rows, "id string, vector array<double>")
    assert E.calibrate_epsilon(df, 0.3, blocks=3) == pytest.approx(distances[int(0.3 * len(distances))])
    assert E.calibrate_epsilon(df.where("id = 'zero'")) == 0.0


def test_dimension_by_mode(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0, 3.0]), (2, [1.0] * 4), (3, None)], "k int, v array<double>")
    out = {}
    for mode in ("vector", "text"):
        v, bad = O.check_dimension(F.col("v"), 3, mode)
        out[mode] = {r["k"]: (r["bad"], r["v"]) for r in df.select("k", bad.alias("bad"), v.alias("v")).collect()}
    assert [out["vector"][k][0] for k in range(4)] == [True, False, True, True]
    assert [out["text"][k][0] for k in range(4)] == [False, False, True, True] and out["text"][0][1] == [1.0, 2.0, 0.0]


def test_ingest_goes_on_from_a_log(spark):
    v = [1.0 if j == 0 else 0.0 for j in range(384)]
    w = [2.0 if j == 1 else 0.0 for j in range(384)]
    log = spark.createDataFrame([("VEC_5", 3, v)], "id string, seq long, vector array<double>")
    new = spark.createDataFrame([(10, 5, w), (11, 6, v), (12, 6, [1.0])], "vec_id long, label int, vector array<double>")
    got = {r["id"]: r for r in O.ingest_vectors(new, basis(spark), 384, log).collect()}
    assert (got["VEC_5"]["seq"], got["VEC_5"]["axis_id"], got["VEC_5"]["k_cin"]) == (4, "AXIS_2", pytest.approx(1.109375))
    assert got["VEC_6"]["seq"] == 1 and got["VEC_6"]["k_cin"] is None and got["LOG_12"]["state"] == "telemetry_error"


def test_halves_of_categories(spark):
    import hashlib

    docs = spark.createDataFrame([(i, "AB"[i % 3 == 0]) for i in range(3000)], "doc_id long, category string").repartition(5)
    got = {r["doc_id"]: r["reference"] for r in C.split_reference(docs).collect()}
    for c in "AB":
        own = sorted((hashlib.md5(f"seed{i}".encode()).hexdigest(), i) for i in range(3000) if "AB"[i % 3 == 0] == c)
        assert [got[i] for _, i in own] == [k < len(own) // 2 for k in range(len(own))]
