"""The registered queries: their columns, types and rows over a whole table."""

import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from corvane.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

COLUMNS = {
    "op1_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op2_substring_dedup": {"doc_id": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op3_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op4_suffix_tree": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op5_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op6_minhash": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op7_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op9_pieces": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op10_order_minhash": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op11_best_fit": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op12_alignment": {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"},
    "op13_periodic_runs": {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"},
}


def test_every_operator_is_registered():
    assert sorted(QUERIES) == sorted(COLUMNS) and not ORACLE_SQL


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_returns_the_whole_table(spark, data, name):
    got = QUERIES[name](spark, data)
    assert COLUMNS[name].items() <= dict(got.dtypes).items()
    table, key = ("pages", "page_id") if name.startswith("op1_") else ("documents", "doc_id")
    ids = [r[0] for r in spark.read.parquet(f"{data}/{table}.parquet").select(key).collect()]
    found = [r[key] for r in got.select(key).collect()]
    assert sorted(set(found)) == sorted(ids) and (len(found) == len(ids) or name in ("op3_packing", "op11_best_fit"))
    if name == "op7_quality_classifier":
        crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
        assert got.where((F.col("held_out") != (crc == 2)) | (F.col("predicted") != (F.col("score") >= 0.7).cast("int")) | ~F.col("score").between(0, 1)).count() == 0
    if name == "op4_suffix_tree":
        assert got.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)).count() == 0 and got.where("score >= 0").count() == 0
    if name == "op6_minhash":
        assert got.where(F.col("kept") != (F.col("doc_id") == F.col("component_id"))).count() == 0
    if name == "op10_order_minhash":
        assert got.agg(F.avg("near_edited")).first()[0] > got.agg(F.avg("near_next")).first()[0]
