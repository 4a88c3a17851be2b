"""Quality rules: fixed text statistics and a calibrated hashed n-gram classifier.

The statistics reject short and repetitive texts.  All others are judged by a
logistic regression over hashed words, word pairs and character n-grams that is
trained on a bounded sample of labelled rows, calibrated by Platt's method on
rows kept out of the fit, and applied to Arrow batches against a fixed threshold.

Defined results: a null text has no words and fails the base rules; without
labels of both classes the model gives every text the one class that there is
(label 1 without any label).  Repeated rows are
judged alike, a probability equal to the threshold keeps a text, and an empty table
gives no rows; rows without an id are judged as others.  ``score_quality_rules``
carries no other columns; ``good_documents`` passes all through, whatever their
names.  A task holds one whole text and some 100 bytes for each of its bytes at a
time, whatever the text's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .labelled import sample_labelled
from .tables import read

BUCKET_BITS = 12
WORD_BUCKETS = CHAR_BUCKETS = 1 << BUCKET_BITS
CHAR_ORDERS = (3, 4)
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
KEEP_FROM = 0.5
#: Bound on the labelled rows of each class that the fit uses.
ROWS_PER_CLASS = 800

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

BASE = tx.arrow_schema(doc_id=pa.int64(), n_words=pa.int64(), word_chars=pa.int64(), n_symbols=pa.int64(), n_dup_lines=pa.int64(), n_repeat_words=pa.int64(), base_failed=pa.bool_(), p_quality=pa.float64(), kept=pa.bool_())


def repeated_words(codes: np.ndarray) -> int:
    """Words in windows of three that occur twice or more, first ones included."""
    n = len(codes)
    if n < 4:
        return 0
    _, ids = np.unique(codes, return_inverse=True)
    m = int(ids.max()) + 1
    _, pairs = np.unique(ids[:-1].astype(np.int64) * m + ids[1:], return_inverse=True)
    _, window, count = np.unique(pairs[:-1].astype(np.int64) * m + ids[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    marked = np.zeros(n, dtype=bool)
    for k in range(3):
        marked[k : n - 2 + k] |= again
    return int(marked.sum())


def base_counts(block: tx.Block, codes: np.ndarray, edges: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    buf, n = block.buf, len(block.start)
    first, last = edges
    inner = (~tx.SPACE[buf]) & ((buf & 0xC0) != 0x80)
    symbols, chars = np.concatenate(([0], np.cumsum(SYMBOL[buf]))), np.concatenate(([0], np.cumsum(inner)))
    dup, repeat = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    whole = buf.tobytes()
    for i in range(n):
        lines = [x for x in whole[block.start[i] : block.end[i]].split(b"\n") if x and not x.isspace()]
        dup[i] = len(lines) - len(set(lines))
        repeat[i] = repeated_words(codes[first[i] : last[i]])
    return {"n_words": last - first, "word_chars": chars[block.end] - chars[block.start], "n_symbols": symbols[block.end] - symbols[block.start], "n_dup_lines": dup, "n_repeat_words": repeat}


def hashed(block: tx.Block, codes: np.ndarray, edges: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Feature groups: offset of the group's buckets, bucket of every item, and each text's run of items."""
    first, last = edges
    yield 0, (codes % tx.U64(WORD_BUCKETS)).astype(np.int64), first, last
    pairs = (codes[:-1] * tx.U64(0x9E3779B97F4A7C15) + codes[1:]) >> tx.U64(64 - BUCKET_BITS)
    yield WORD_BUCKETS, pairs.astype(np.int64), np.minimum(first, len(pairs)), np.maximum(np.minimum(first, len(pairs)), last - 1)
    raw = block.buf.astype(np.uint32)
    for at, n in enumerate(CHAR_ORDERS):
        m = max(0, len(raw) - n + 1)
        gram = np.zeros(m, dtype=np.uint32)
        for k in range(n):
            gram |= raw[k : k + m] << np.uint32(8 * k)
        start = np.minimum(block.start, m)
        yield 2 * WORD_BUCKETS + at * CHAR_BUCKETS, ((gram * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), start, np.maximum(start, np.minimum(m, block.end - n + 1))


N_FEATURES = 2 * WORD_BUCKETS + len(CHAR_ORDERS) * CHAR_BUCKETS


def dense(column: pa.Array) -> Iterator[tuple[tx.Block, np.ndarray]]:
    """Relative frequencies of the buckets in each group, a row for each text."""
    for block in tx.blocks(column, 1 << 18):
        codes, edges = block_words(block)
        x = np.zeros((len(block.start), N_FEATURES), dtype=np.float32)
        for offset, items, a, z in hashed(block, codes, edges):
            width = WORD_BUCKETS if offset < 2 * WORD_BUCKETS else CHAR_BUCKETS
            for i in range(len(a)):
                if z[i] > a[i]:
                    x[i, offset : offset + width] = np.bincount(items[a[i] : z[i]], minlength=width) / (z[i] - a[i])
        yield block, x


def block_words(block: tx.Block) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    s, e, of = block.words()
    return tx.span_hash(tx.prefix_hash(block.buf), s, e), tx.per_text(len(block.start), of)


@dataclass
class RulesModel:
    """A fixed number of weights, and Platt's slope and intercept."""

    weights: np.ndarray
    bias: float
    slope: float
    intercept: float

    def probability(self, block: tx.Block, codes: np.ndarray, edges: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        z = np.full(len(block.start), self.bias)
        for offset, items, a, b in hashed(block, codes, edges):
            z += tx.segment_sums(self.weights[offset:][items], a, b) / np.maximum(1, b - a)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.intercept, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Full-batch Adam on features scaled by their root mean square; weights are for the raw features."""
    scale = (1 / (np.sqrt(np.einsum("ij,ij->j", x, x) / len(x)) + 1e-4)).astype(np.float32)
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    m = v = np.zeros(x.shape[1] + 1)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    # scaled weights stand for scaled features: the matrix is not copied
    for t in range(1, steps + 1):
        g = ((1 / (1 + np.exp(-np.clip(x @ (w * scale) + b, -40, 40))) - y) * share).astype(np.float32)
        grad = np.concatenate(((g @ x) * scale + decay * w, [g.sum()]))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - step[-1]
    return (w * scale).astype(np.float64), float(b)


def fit_platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept by Newton's method, with Platt's softened targets."""
    up, down = weight[y == 1].sum(), weight[y == 0].sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    design, p = np.stack((z, np.ones_like(z)), axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(design @ p, -30, 30)))
        grad = design.T @ (weight * (q - target)) + ridge * (p - [1, 0])
        hess = (design * (weight * q * (1 - q))[:, None]).T @ design + ridge * np.eye(2)
        move = np.linalg.solve(hess, grad)
        p = p - move / max(1.0, np.abs(move).max())
    return float(p[0]), float(p[1])


FEATURE_ROWS = tx.arrow_schema(doc_id=pa.int64(), label=pa.int32(), weight=pa.float64(), buckets=pa.binary(), shares=pa.binary())


def train(documents: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> RulesModel:
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            for block, x in dense(one["text"]):
                part = one.slice(int(block.index[0]), len(block.index))
                used = [np.flatnonzero(row) for row in x]
                yield tx.batch({"doc_id": part["doc_id"], "label": part["label"], "weight": part["weight"], "buckets": [u.astype(np.uint16).tobytes() for u in used], "shares": [row[u].tobytes() for row, u in zip(x, used, strict=True)]}, FEATURE_ROWS)

    sample = sample_labelled(documents, labels, "quality", rows_per_class)
    got = sample.mapInArrow(extract, tx.spark_schema(FEATURE_ROWS)).toPandas().sort_values("doc_id", ignore_index=True)
    y = got["label"].to_numpy(dtype=np.float64)
    if len(got) == 0 or y.min() == y.max():
        return RulesModel(np.zeros(N_FEATURES), 0.0, 0.0, -40.0 if len(got) and y[0] == 0 else 40.0)
    aside = np.random.default_rng(11).permutation(len(y)) % 4 == 0
    if any(len(np.unique(y[part])) < 2 for part in (aside, ~aside)):
        fit = held = slice(None)
    else:  # rows kept out of the fit last, so that both parts are views
        order, n = np.argsort(aside, kind="stable"), int((~aside).sum())
        got, y, fit, held = got.iloc[order], y[order], slice(0, n), slice(n, None)
    x = np.zeros((len(got), N_FEATURES), dtype=np.float32)
    for row, buckets, shares in zip(x, got["buckets"], got["shares"], strict=True):
        row[np.frombuffer(buckets, dtype=np.uint16)] = np.frombuffer(shares, dtype=np.float32)
    w, b = fit_logistic(x[fit], y[fit])
    slope, intercept = fit_platt(x[held] @ w + b, y[held], got["weight"].to_numpy()[held])
    return RulesModel(w, b, slope, intercept)


def score_quality_rules(documents: DataFrame, model: RulesModel, threshold: float = KEEP_FROM) -> DataFrame:
    """doc_id with the base statistics, p_quality and kept, a row for each input row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            for block in tx.blocks(one["text"]):
                codes, edges = block_words(block)
                out = base_counts(block, codes, edges)
                p = shared.value.probability(block, codes, edges)
                failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEATED_PERCENT * out["n_words"])
                yield tx.batch(out | {"doc_id": one["doc_id"].slice(int(block.index[0]), len(block.index)), "base_failed": failed, "p_quality": p, "kept": ~failed & (p >= threshold)}, BASE)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(judge, tx.spark_schema(BASE))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return score_quality_rules(documents, train(documents, read(spark, sf_dir, "labels")))


def good_documents(documents: DataFrame, model: RulesModel, threshold: float = KEEP_FROM) -> DataFrame:
    """The rows that the rules keep, with all their columns; nothing is shuffled."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            for block in tx.blocks(one["text"]):
                codes, edges = block_words(block)
                out = base_counts(block, codes, edges)
                failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEATED_PERCENT * out["n_words"])
                good = ~failed & (shared.value.probability(block, codes, edges) >= threshold)
                yield one.slice(int(block.index[0]), len(block.index)).filter(pa.array(good))

    return documents.mapInArrow(choose, documents.schema)
