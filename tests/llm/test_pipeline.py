"""The pipeline's stages, each on all that its predecessor kept."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert sorted(out.columns) == sorted(columns), name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k == 0:
            kept = {r["doc_id"] for r in docs.collect()}
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in kept for i in good) > 0.8 * len(good)
            assert not any(i in kept for i, q in labels.items() if q == 0)
        sizes.append(docs.select("doc_id").distinct().count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert sizes[-1] == sizes[-2]


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0


ODD = [(None, None), (None, "a b c"), (900_001, None), (900_002, ""), (900_003, " \n "), (900_004, "x" * 300_000), (900_005, "same words again " * 20_000)]


@pytest.fixture(scope="module")
def odd(spark, data):
    """Real documents, some rows of them again, odd texts, and columns whose names the stages use."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], docs.schema)
    docs = docs.unionByName(rows).unionByName(docs.orderBy("doc_id").limit(5))
    return docs.withColumns({c: F.lit("clash") for c in ("kept", "score", "found", "label", "removed_spans", "n_removed", "part", "prompt", "keys")})


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stage_on_odd_rows(spark, data, odd, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd, data)
    got = out.collect()
    if name == "packing":
        ids = [r["doc_id"] for r in odd.select("doc_id").collect()]
        whole = {}
        for r in got:
            whole.setdefault(r["doc_id"], 0)
            whole[r["doc_id"]] += r["length"]
        assert set(whole) == set(ids) and whole[900_001] == whole[900_002] == 1
    else:
        assert out.columns == corpus_pipeline.COLUMNS
        texts = {}
        for r in got:
            texts.setdefault(r["doc_id"], []).append(r["text"])
        if name.startswith("quality"):
            assert name == "quality_classifier" or not {900_001, 900_002, 900_003, 900_004, 900_005} & set(texts)
        elif name == "minhash_near_dedup":
            assert {None, 900_001, 900_002, 900_003, 900_004, 900_005} <= set(texts) and len(texts[None]) == 2
        else:
            assert len(got) == odd.count() and texts[900_001] == [None] and texts[900_002] == [""] and sorted(texts[None], key=str) == [None, "a b c"]
    nothing = stage(spark, odd.limit(0), data)
    assert nothing.count() == 0 and nothing.columns == out.columns
