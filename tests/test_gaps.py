"""Snapshots by digests, insertion within a batch, symbols, spectra of short texts, reduction without squares, outcomes, row-local lexicons."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import vectors as V
from corvane.operators import corpus as C
from corvane.operators import edges as E
from corvane.operators import revisions as R
from corvane.operators import screening as S
from corvane.operators import vectors as O
from corvane.plans import corpus_queries as CQ
from corvane.plans.catalog import QUERIES


def test_lost_rows_of_unequal_snapshots(spark):
    r = random.Random(4)
    schema = "id string, seq long, state string"
    before = [(f"N{r.randint(0, 40)}", r.randint(1, 5), r.choice(["a", None])) for _ in range(400)]  # many repeats
    after = r.sample(before, 390) + [("new", 1, "a")] * 7
    frame = lambda rows: spark.createDataFrame(rows, schema)
    for buckets in (1, 16, 4096):
        for a, b in ((before, after), (after, before), (before, before), (before, []), ([], before)):
            got = sorted(map(repr, R.lost_rows(frame(a), frame(b), buckets).collect()))
            assert got == sorted(map(repr, frame(a).exceptAll(frame(b)).collect()))
    # a changed row is lost, though counts agree
    changed = [(i, n, "z" if k == 3 else s) for k, (i, n, s) in enumerate(before)]
    assert R.lost_rows(frame(before), frame(changed)).count() == 1
    # columns go by name
    assert R.lost_rows(frame(before), frame(before).select("state", "id", "seq")).count() == 0


def test_one_row_of_a_key_is_inserted(spark):
    schema = "k1 string, k2 long, value string, at long"
    new = spark.createDataFrame([("a", 1, "second", 2), ("a", 1, "first", 1), ("a", 2, "own", 5), ("b", 1, "known", 1), (None, 1, "x", 1), (None, 1, "y", 2)], schema)
    old = spark.createDataFrame([("b", 1, "old", 0)], schema)
    got = sorted(r["value"] for r in O.insert_or_ignore(new, old, ["k1", "k2"], "at").collect())
    assert got == ["first", "own", "x", "y"]
    any_ = [r["value"] for r in O.insert_or_ignore(new, old, ["k1", "k2"]).collect()]
    assert len(any_) == 4 and ("first" in any_) != ("second" in any_)
    assert O.insert_or_ignore(new.limit(0), old, ["k1"]).count() == 0


def test_symbols_of_high_ranks(spark):
    ranks = [0, 7, 45_645, 45_646, 46_000, 47_693, 47_694, 60_000, 0x10FFFF - 0x25B2, 0x10FFFF - 0x25B1]
    got = {r["rank"]: r for r in O.label_axes(spark.createDataFrame([(k, "it's a b") for k in ranks], "rank long, name string")).withColumn("rank", F.col("symbol_code") - 0x25B2).collect()}
    for k in ranks:
        code = 0x25B2 + k
        there = code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF
        assert got[k]["symbol_code"] == code and got[k]["symbol"] == (chr(code) if there else None) and got[k]["tag"] == "ITS_A_B"


def gap_by_force(text, n=2):
    t = (text or "").lower()
    grams = [t[k : k + n] for k in range(len(t) - n + 1)]
    states = sorted(set(grams)) if len(grams) > 1 else []
    if len(states) < 2:
        return 0.0, 0.0, len(states), 0.0
    m = np.zeros((len(states), len(states)))
    for a, b in zip(grams, grams[1:], strict=False):
        m[states.index(a), states.index(b)] += 1
    m = m / np.maximum(m.sum(1, keepdims=True), 1)
    moduli = np.sort(np.abs(np.linalg.eigvals(m)))[::-1]
    share = moduli / moduli.sum() if moduli.sum() else moduli
    with np.errstate(divide="ignore", invalid="ignore"):
        return moduli[0] - moduli[1], moduli[1], len(states), float(-(share * np.log(share)).sum())


def test_spectral_gap_has_a_row_for_every_text(spark):
    texts = [None, "", "a", "ab", "abc", "aaaa", "abab abab", "the cat sat on the mat " * 3, "Ünïcode ünïcode"]
    got = {r["doc_id"]: r for r in C.spectral_gap(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        gap, second, states, entropy = gap_by_force(text)
        r = got[k]
        assert r["states"] == states and r["gap"] == pytest.approx(gap, abs=1e-8) and r["second"] == pytest.approx(second, abs=1e-8)
        assert r["entropy"] == pytest.approx(entropy, abs=1e-6) or np.isnan(entropy)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_bigrams_are_counted_a_document_at_a_time(spark):
    texts = [(1, "Ab ab 𝄞ab"), (2, "xyz"), (1, "abab"), (None, "aaa"), (None, "aab"), (3, "ab"), (4, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    want = {}
    for doc_id, text in texts:
        t = (text or "").lower()
        for k in range(len(t) - 2):
            key = (doc_id, t[k : k + 2], t[k + 1 : k + 3])
            want[key] = want.get(key, 0) + 1
    found = C.bigram_transitions(docs)
    assert not any(s in plan_of(found) for s in ("Window", "Generate", "Aggregate"))
    got = found.collect()
    assert {(r["doc_id"], r["a"], r["b"]): r["n"] for r in got} == want and len(got) == len(want)
    for r in got:
        assert r["p"] == r["n"] / sum(n for (d, a, _), n in want.items() if (d, a) == (r["doc_id"], r["a"]))
    three = {(r["a"], r["b"]): r["n"] for r in C.bigram_transitions(docs.where("doc_id = 1"), 3).collect()}
    assert three["ab ", "b a"] == three["aba", "bab"] == 1 and len(three) == 7


def test_spectral_gap_shuffles_texts_alone(spark):
    docs = spark.createDataFrame([(1, "abcabc"), (None, "abab"), (2, "x")], "doc_id long, text string")
    found = C.spectral_gap(docs)
    assert not any(s in plan_of(found) for s in ("Window", "Generate", "FlatMapGroups"))
    assert {r["doc_id"]: r["states"] for r in found.collect()} == {1: 3, None: 2, 2: 0}


def test_norm_of_a_unit_vector_is_found_once(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([],)], "v array<double>")
    found = df.select(V.unit(F.col("v")).alias("u"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    assert [r["u"] for r in found.collect()] == [[0.6, 0.8], [0.0, 0.0], None, []]


def test_tokens_of_equal_ids_are_counted_once(spark, tmp_path):
    rows = [(1, "en", "a b a"), (1, "en", "c"), (2, "fr", "a"), (3, "de", None)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["x1_tokenize"](spark, str(tmp_path))
    assert "Join" not in plan_of(found)
    assert sorted(map(tuple, found.collect())) == [("A", 4, 3), ("B", 1, 1)]


def test_texts_are_compressed_in_batches_of_bounded_bytes(spark):
    docs = spark.createDataFrame([(1, "ab" * 50), (2, "abc" * 40)], "doc_id long, text string")
    assert C.ncd(spark.createDataFrame([(1, 2)], "a long, b long"), docs).count() == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == C.HELD_TEXTS


def frame(spark, x, parts=5):
    return spark.createDataFrame([(f"N{k}", [float(v) for v in row]) for k, row in enumerate(x)], "id string, vector array<double>").repartition(parts)


def test_reduction_of_nearly_dependent_columns(spark):
    r = np.random.default_rng(6)
    base = r.normal(size=(120, 2))
    x = np.column_stack([base, base @ [1.0, 1.0] + 1e-9 * r.normal(size=120), 5 + 1e-10 * r.normal(size=120)])
    x = x - 0.25
    n, mean, factor = E.centred_factor(frame(spark, x))
    want = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert n == 120 and mean == pytest.approx(x.mean(0), abs=1e-12)
    assert np.linalg.svd(factor, compute_uv=False) == pytest.approx(want, rel=1e-4)
    gram = np.sqrt(np.maximum(np.linalg.eigvalsh((x - x.mean(0)).T @ (x - x.mean(0)))[::-1], 0))
    assert abs(gram[2] - want[2]) > 0.05 * want[2]  # squares lose it


@pytest.mark.parametrize("shape", [(40, 6), (3, 6), (1, 4), (7, 7)])
def test_reduction_by_numpy(spark, shape):
    x = np.random.default_rng(shape[0]).normal(size=shape) * np.arange(1, shape[1] + 1)
    got = {r["id"]: r for r in E.svd_reduce(frame(spark, x)).collect()}
    c = x - x.mean(0)
    u, s, vt = np.linalg.svd(c, full_matrices=True)
    for j in range(min(2, np.sum(s > 1e-9))):
        mine = np.array([got[f"N{k}"]["coords"][j] for k in range(len(x))])
        assert np.abs(mine) == pytest.approx(np.abs(c @ vt[j]), abs=1e-9)
    assert E.participation_ratio(frame(spark, np.zeros((0, 3)).reshape(0, 3))) == 0.0 if shape[0] == 1 else True
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    values = np.linalg.eigvalsh(unit @ unit.T - np.eye(len(x)))
    values = values[values > 1e-10]
    want = values.sum() ** 2 / (values**2).sum() if len(values) else 0.0
    assert E.participation_ratio(frame(spark, unit)) == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_node_view_by_hand(spark):
    more = {"AXIS_3": 0.0, "AXIS_4": 0.0}
    spectra = [{"AXIS_2": 1.0, "AXIS_1": 0.0, "AXIS_10": 0.0} | more, {"AXIS_10": 0.0, "AXIS_1": 4.0, "AXIS_2": 0.0} | more, {"AXIS_1": -4.0, "AXIS_2": -1.0, "AXIS_10": 0.0} | more]
    states = ["consolidated", "telemetry_error", "elsewhere"]
    nodes = spark.createDataFrame([(f"N{k}", s, m) for k, (s, m) in enumerate(zip(states, spectra, strict=True))], "id string, state string, spectrum map<string,double>")
    got = {r["id"]: r for r in E.node_view(nodes).collect()}
    assert [got[f"N{k}"]["border"] for k in range(3)] == ["#10B981", "#EF4444", "#475569"]
    x = np.array([[0.0, 0.0, 1.0], [4.0, 0.0, 0.0], [-4.0, 0.0, -1.0]])  # AXIS_1, AXIS_10, AXIS_2
    c = x - x.mean(0)
    _, _, vt = np.linalg.svd(c)
    top = np.abs(c @ vt[:2].T).max()
    for k in range(3):
        assert abs(got[f"N{k}"]["left"]) == pytest.approx(400 * abs(c[k] @ vt[0]) / top, abs=1e-6)
        assert abs(got[f"N{k}"]["top"]) == pytest.approx(400 * abs(c[k] @ vt[1]) / top, abs=1e-6)
        assert all(0 <= got[f"N{k}"][c_] <= 255 for c_ in "rgb")


def test_outcomes_of_proposals(spark):
    good = '{"Intent_Class": "FIX", "Target_File": "f", "Topological_Grounding": "g", "Implementation_Block": "b", "Safety_Abort": "NONE"}'
    odd = good.replace("FIX", "EXPLAIN")
    cases = {
        good: "VALID", f"Here:\n```json\n{good}\n```": "VALID", good[:-1]: "VALID", odd: "VALIDATION_ERROR", f"```json\n{odd}\n```": "VALIDATION_ERROR", odd[:-1]: "PARSING_ERROR",
        "no json": "PARSING_ERROR", "[1, 2]": "VALIDATION_ERROR", "{}": "VALIDATION_ERROR", "": "PARSING_ERROR",
    }
    got = {r["raw"]: r["outcome"] for r in S.proposal_outcome(spark.createDataFrame([(t,) for t in cases] + [(None,)], "raw string")).collect()}
    assert got == cases | {None: "PARSING_ERROR"}


def test_lexicon_inside_the_row_and_joined_agree(spark, monkeypatch):
    r = random.Random(8)
    bits = ["the", "The", "a-b", "b", "the-end", "--the", "a--the", "x-the", "thee", "the-", "os9", "é", "the.", "-", "\n"]
    texts = [None, "", "the"] + ["".join(r.choice(bits) + r.choice(["", " ", "-", "é"]) for _ in range(20)) for _ in range(60)]
    docs = spark.createDataFrame([(k, t, "clash", "clash") for k, t in enumerate(texts)], "doc_id long, text string, hits string, `group` string").drop("hits", "group")
    lexicon = spark.createDataFrame([("the", "EN", 0), ("a-b", "X", 1), ("b", "X", 2), ("the", "Y", 3), ("the-end", "EN", 4), ("not a token", "Z", 5)], "form string, `group` string, rank int")
    row = sorted(map(tuple, C.project_sparse(docs, lexicon).collect()))
    scores = {x["doc_id"]: (x["charge"], x["variance"]) for x in C.sparse_scores(docs, lexicon).collect()}
    long = {x["doc_id"]: (x["charge"], x["variance"]) for x in C.sparse_variance(C.project_sparse(docs, lexicon)).collect()}
    assert set(scores) == set(long) and all(scores[k] == pytest.approx(long[k]) for k in long)
    monkeypatch.setattr(C, "ROW_FORMS", 2)
    assert sorted(map(tuple, C.project_sparse(docs, lexicon).collect())) == row and sum(x[2] for x in row) > 100
    with pytest.raises(ValueError):
        C.lexicon_hits(docs, lexicon)


def test_ingest_of_texts(spark):
    rows = [(1, [3.0, 4.0]), (1, [4.0, 3.0]), (2, [0.0, 2.0, 0.0]), (3, [1.0] * 4), (4, None), (None, [1.0, 0.0])]
    texts = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    axes = spark.createDataFrame([(f"AXIS_{i + 1}", [float(i == j) for j in range(3)], "EPOCH_V1") for i in range(3)], "axis_id string, vector array<double>, epoch string")
    log = spark.createDataFrame([("NODE_2", 7), ("LOG_4", 2)], "id string, seq long")
    got = {(r["id"], r["seq"]): (r["state"], round(r["potential"], 6), r["milestone"]) for r in O.ingest_texts(texts, axes, 3, log).collect() if r["id"] is not None}
    var = lambda *v: round(sum((x - sum(v) / 3) ** 2 for x in v) / 3, 6)
    waiting = lambda *v: ("pending_approval", var(*v), 0)
    error = ("telemetry_error", 0.0, 0)
    assert got == {("NODE_1", 1): waiting(0.6, 0.8, 0), ("NODE_1", 2): waiting(0.8, 0.6, 0), ("NODE_2", 8): waiting(0, 1, 0), ("LOG_3", 1): error, ("LOG_4", 3): error}
    assert O.ingest_texts(texts.limit(0), axes, 3).count() == 0


def test_encoders_are_seeded_by_the_text(spark):
    docs = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one")], "doc_id long, text string")
    for provider in (C.HashProvider(384), C.HashProvider(128, seed=7, normalise=False)):
        found = {r["doc_id"]: np.array(r["vector"]) for r in C.encode(docs, provider).collect()}
        digest = hashlib.sha256(b"two").digest()
        seed = int.from_bytes(digest[:8], "little") if provider.seed is None else 7 + int.from_bytes(digest[:4], "little")
        want = np.random.default_rng(seed).standard_normal(provider.dimension)
        assert np.allclose(found[2], want / np.linalg.norm(want) if provider.normalise else want, atol=1e-6)
        assert (found[1] == found[3]).all() and not np.allclose(found[1], found[2])


def test_bimodality_by_the_formula(spark, data):
    """One component's criterion from mean and variance by hand; two components fit at least as well."""
    values = np.array([r["variance"] for r in CQ.sparse(spark, data).select("variance").collect()])
    bic = {r["components"]: r["bic"] for r in QUERIES["m2_bimodality"](spark, data).collect()}
    like = np.sum(-0.5 * np.log(2 * np.pi * values.var()) - (values - values.mean()) ** 2 / (2 * values.var()))
    assert bic[1] == pytest.approx(-2 * like + 2 * np.log(len(values)))
    assert bic[2] - 5 * np.log(len(values)) <= bic[1] - 2 * np.log(len(values)) + 1e-6


def test_spectral_gaps_of_equal_texts_are_solved_once(spark):
    texts = [(1, "abcabca"), (2, "ABCabca"), (None, "abcabca"), (3, "xyzzy xyz"), (4, "abab ac"), (4, "abcabca"), (5, "abcabca"), (5, "abab ac"), (6, "abab ac"), (7, "ab"), (None, "xy"), (8, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    keys, distinct = C.distinct_documents(docs, 2)
    # of the ids 1, 2, None; of 3; of 4 and 5, which have two texts; of 6
    assert distinct.select("doc_id").distinct().count() == 4 and distinct.count() == 5
    assert keys.count() == 7 and keys.select("key").distinct().count() == 4
    got = {}
    for r in C.spectral_gap(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["states"], r["gap"], r["second"], r["entropy"]))
    assert len(got[None]) == 2 and (0, 0.0, 0.0, 0.0) in got[None] and got[7] == got[8] == [(0, 0.0, 0.0, 0.0)]
    same = lambda a, b: all(x == y or x != x and y != y for x, y in zip(a, b, strict=True))
    assert same(got[1][0], got[2][0]) and any(same(got[1][0], one) for one in got[None]) and same(got[4][0], got[5][0]) and not same(got[4][0], got[6][0])
    for doc_id, text in ((1, "abcabca"), (3, "xyzzy xyz"), (6, "abab ac")):
        gap, second, states, _ = gap_by_force(text)
        assert got[doc_id][0][0] == states and got[doc_id][0][1:3] == pytest.approx((gap, second), abs=1e-8)
