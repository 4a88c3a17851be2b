"""The registered queries of this package, by name, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op12_alignment
from .best_fit import op11_best_fit
from .quality_rules import op5_quality_rules
from .fingerprints import op10_order_minhash
from .minhash import op6_minhash
from .packing import op3_packing
from .periodic import op13_periodic_runs
from .pieces import op9_pieces
from .quality_classifier import op7_quality_classifier
from .suffix_tree import op4_suffix_tree
from .suffixes import op8_suffix_dedup
from .substring import op2_substring_dedup
from .url_filter import op1_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_packing": op3_packing,
    "op4_suffix_tree": op4_suffix_tree,
    "op5_quality_rules": op5_quality_rules,
    "op6_minhash": op6_minhash,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_pieces": op9_pieces,
    "op10_order_minhash": op10_order_minhash,
    "op11_best_fit": op11_best_fit,
    "op12_alignment": op12_alignment,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {}
