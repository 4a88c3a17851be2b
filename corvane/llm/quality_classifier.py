"""Quality classifier: random-indexing word vectors, pooled, and a small network.

*Random indexing.*  Every word has a sparse ternary index vector given by its
hash.  A word's context vector is the sum of the index vectors of its neighbours
over all documents.  Words are hashed to a fixed number of rows, so the table has
a fixed size however large the vocabulary grows: each task adds up its own table
and the tables are added by row blocks in a shuffle.

*Classifier.*  Mean and deviation of a document's word vectors go through a
two-layer numpy network, fitted on a bounded sample of labelled rows, whose
probabilities are calibrated by a temperature on rows kept out of the fit.

Defined results: a null or empty text has a zero vector and gets the network's
score for it; without labels of both classes every score is the one class there
is (1.0 without any label).  Repeated rows are scored alike, rows without an id as
others (they are not held out), and a score equal to the threshold predicts 1.  An
empty table gives no rows.  ``score_quality`` carries no other columns;
``good_documents`` passes all through, whatever their names.  A task holds one whole
text and some 100 bytes for each of its bytes at a time, whatever the text's length.
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

WORD_ROWS = 1 << 14
WIDTH = 32
NONZERO = 2
REACH = 2
HIDDEN = 24
ROWS_PER_CLASS = 1500
PREDICT_FROM = 0.7
#: Rows of the table that travel together.
STRIP = 256

STRIPS = tx.arrow_schema(strip=pa.int64(), sums=pa.binary())
POOLED = tx.arrow_schema(doc_id=pa.int64(), label=pa.int32(), weight=pa.float64(), features=pa.binary())
SCORES = tx.arrow_schema(doc_id=pa.int64(), score=pa.float64())


def word_rows(block: tx.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the number of its text."""
    s, e, of = block.words()
    return tx.span_hash(tx.prefix_hash(block.buf), s, e), of


def add_contexts(table: np.ndarray, hashes: np.ndarray, of: np.ndarray) -> None:
    """Add the neighbours' index vectors to each word's row."""
    rows = (hashes % tx.U64(WORD_ROWS)).astype(np.int64) * WIDTH
    for k in range(NONZERO):
        bits = (hashes >> tx.U64(20 + 12 * k)).astype(np.int64)
        place, sign = bits % WIDTH, (1 - 2 * ((bits >> 8) & 1)).astype(np.float32)
        for gap in range(1, REACH + 1):
            near = of[gap:] == of[:-gap]
            for word, other in ((rows[:-gap], slice(gap, None)), (rows[gap:], slice(None, -gap))):
                table += np.bincount(word[near] + place[other][near], weights=sign[other][near], minlength=table.size)


def word_vectors(documents: DataFrame) -> np.ndarray:
    """Context vectors from all documents, ``WORD_ROWS`` unit rows."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(WORD_ROWS * WIDTH)
        for one in batches:
            for block in tx.blocks(one["text"]):
                add_contexts(table, *word_rows(block))
        parts = table.astype(np.float32).reshape(-1, STRIP * WIDTH)
        used = np.flatnonzero(parts.any(axis=1))
        yield tx.batch({"strip": used, "sums": [parts[i].tobytes() for i in used]}, STRIPS)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for one in batches:
            for strip, sums in zip(one["strip"].to_pylist(), one["sums"], strict=True):
                part = np.frombuffer(sums.as_buffer(), dtype=np.float32)
                total[strip] = total[strip] + part if strip in total else part.astype(np.float64)
        yield tx.batch({"strip": list(total), "sums": [x.astype(np.float32).tobytes() for x in total.values()]}, STRIPS)

    texts = documents.select(F.col("text").cast("binary").alias("text"))
    strips = texts.mapInArrow(own, tx.spark_schema(STRIPS))
    summed = strips.repartition(WORD_ROWS // STRIP, "strip").mapInArrow(added, tx.spark_schema(STRIPS))
    table = np.zeros((WORD_ROWS // STRIP, STRIP * WIDTH))
    for row in summed.collect():  # WORD_ROWS * WIDTH floats, whatever the input
        table[row["strip"]] += np.frombuffer(row["sums"], dtype=np.float32)
    table = table.reshape(WORD_ROWS, WIDTH)
    table -= table.sum(axis=0) * (np.abs(table).sum(axis=1, keepdims=True) / max(1.0, np.abs(table).sum()))
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(vectors: np.ndarray, block: tx.Block) -> np.ndarray:
    """Mean and standard deviation of each text's word vectors; zeros without words."""
    hashes, of = word_rows(block)
    rows = (hashes % tx.U64(WORD_ROWS)).astype(np.int64)
    n = len(block.start)
    out = np.zeros((n, 2 * WIDTH), dtype=np.float64)
    first, last = tx.per_text(n, of)
    for i in np.flatnonzero(last > first):
        total, square = np.zeros(WIDTH), np.zeros(WIDTH)
        for at in range(first[i], last[i], 1 << 16):
            part = vectors[rows[at : min(at + (1 << 16), last[i])]]
            total += part.sum(axis=0, dtype=np.float64)
            square += np.einsum("ij,ij->j", part, part, dtype=np.float64)
        count = last[i] - first[i]
        out[i, :WIDTH] = total / count
        out[i, WIDTH:] = np.sqrt(np.maximum(square / count - out[i, :WIDTH] ** 2, 0))
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 400, rate: float = 0.02, decay: float = 1e-3):
    """Two layers by full-batch Adam from a fixed start; classes weigh alike."""
    start = np.random.default_rng(5)
    shapes = ((x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN,), (1,))
    params = [start.normal(0, 1 / np.sqrt(x.shape[1]), shapes[0]), np.zeros(HIDDEN), start.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    for t in range(1, steps + 1):
        h = np.tanh(x @ params[0] + params[1])
        g = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -40, 40))) - y) * weight
        back = np.outer(g, params[2]) * (1 - h * h)
        grads = [x.T @ back + decay * params[0], back.sum(axis=0), h.T @ g + decay * params[2], np.array([g.sum()])]
        for p, d, m, v in zip(params, grads, first, second, strict=True):
            m *= 0.9
            m += 0.1 * d
            v *= 0.999
            v += 0.001 * d * d
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return params[0], params[1], params[2], float(params[3][0])


def fit_temperature(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The temperature of least log loss on a fixed grid."""
    grid = np.geomspace(0.25, 8, 61)
    sign = np.where(y == 1, -z, z)
    return float(grid[np.argmin([(weight * np.logaddexp(0, sign / t)).sum() for t in grid])])


def train(documents: DataFrame, labels: DataFrame, allowed=None, rows_per_class: int = ROWS_PER_CLASS) -> QualityModel:
    """Vectors from all documents; the network from at most ``2 * rows_per_class`` labelled ones."""
    vectors = word_vectors(documents)
    shared = documents.sparkSession.sparkContext.broadcast(vectors)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            for block in tx.blocks(one["text"]):
                part = one.slice(int(block.index[0]), len(block.index))
                yield tx.batch({"doc_id": part["doc_id"], "label": part["label"], "weight": part["weight"], "features": [r.tobytes() for r in pooled(shared.value, block)]}, POOLED)

    got = sample_labelled(documents, labels, "quality", rows_per_class, allowed).mapInArrow(extract, tx.spark_schema(POOLED)).toPandas().sort_values("doc_id", ignore_index=True)
    y, width = got["label"].to_numpy(dtype=np.float64), 2 * WIDTH
    if len(got) == 0 or y.min() == y.max():
        return QualityModel(vectors, np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), -40.0 if len(got) and y[0] == 0 else 40.0, 1.0)
    x = np.stack([np.frombuffer(b) for b in got["features"]])
    aside = np.random.default_rng(3).permutation(len(y)) % 4 == 0
    if any(len(np.unique(y[part])) < 2 for part in (aside, ~aside)):
        aside = np.zeros(len(y), dtype=bool)
    fit = ~aside
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    share = np.where(y[fit] == 1, 0.5 / (y[fit] == 1).sum(), 0.5 / (y[fit] == 0).sum())
    model = QualityModel(vectors, mean, scale, *fit_network((x[fit] - mean) / scale, y[fit], share), 1.0)
    held = aside if aside.any() else fit
    model.temperature = fit_temperature(model.logits(x[held]), y[held], got["weight"].to_numpy()[held])
    return model


def score_quality(documents: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score (0 to 1), a row for each input row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            for block in tx.blocks(one["text"]):
                yield tx.batch({"doc_id": one["doc_id"].slice(int(block.index[0]), len(block.index)), "score": shared.value.score(pooled(shared.value.vectors, block))}, SCORES)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(judge, tx.spark_schema(SCORES))


def held_out():
    """Rows whose labels may not be learnt."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = train(documents, read(spark, sf_dir, "labels"), ~held_out())
    return score_quality(documents, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))


def good_documents(documents: DataFrame, model: QualityModel, threshold: float = PREDICT_FROM) -> DataFrame:
    """The rows that score at least the threshold, with all their columns; nothing is shuffled."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            for block in tx.blocks(one["text"]):
                good = shared.value.score(pooled(shared.value.vectors, block)) >= threshold
                yield one.slice(int(block.index[0]), len(block.index)).filter(pa.array(good))

    return documents.mapInArrow(choose, documents.schema)
