"""Language-model scoring with a probabilistic suffix tree over bytes.

A text is its words, A-Z lower-cased, joined by single spaces and closed by an end
symbol.  Counts of all runs of ``DEPTH + 1`` symbols are gathered from every
training text.  A context is kept in the tree if it makes up at least ``P_MIN`` of
all symbols and its next symbols diverge from those after its longest proper
suffix (count times Kullback-Leibler divergence of at least ``DIVERGENCE`` nats);
the suffixes of kept contexts are kept too.  At most ``1 / P_MIN`` contexts of a
length can be so frequent, which bounds the tree whatever the corpus.

Next-symbol distributions are smoothed by taking ``DISCOUNT`` from each count and
giving the mass to the distribution of the next shorter context.  A symbol is
scored in the state of its longest kept suffix.

The base score is that of single words with add-one smoothing.  Words that make
up at least ``COMMON`` of the tokens, of which there are at most ``1 / COMMON``,
are scored where the text is read; only rarer words are joined to their counts,
so no key of the join holds more than that share.

Defined results: a null or empty text is the end alone; repeated rows are scored
one by one; rows without an id are scored and belong to the training texts; an empty
table gives no rows; other columns than doc_id are not carried, whatever their names;
without training texts the tree is its root with uniform symbols, and
the base score is 0 for every token's logarithm of one.  Contexts that are exactly as
frequent as the bound are kept, and so are those that diverge by exactly the bound.
A task holds one whole text and some 150 bytes for each of its bytes at a time,
whatever the text's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .tables import keep_table, read

DEPTH = 5
P_MIN = 5e-7
#: A next symbol of a context is listed from this share of P_MIN on.
LISTED = 1 / 4
DIVERGENCE = 10.0
DISCOUNT = 0.5
COMMON = 2e-6
#: Different keys that a task holds before it hands them on.
HELD = 4_000_000

GRAM, WORD, TEXTS, SUMMARY = 0, 1, 2, 3
COUNTS = tx.arrow_schema(kind=pa.int32(), key=pa.int64(), n=pa.int64())
PARTS = tx.arrow_schema(row=pa.int64(), doc_id=pa.int64(), kind=pa.int32(), key=pa.int64(), n=pa.int64(), n_tokens=pa.int64(), n_known=pa.int64(), logs=pa.float64(), score=pa.float64())

END = 10


def symbols(block: tx.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, the place of each text's end symbol, word hashes, and each word's text."""
    s, e, of = block.words()
    buf = np.append(block.buf, np.uint8(END))
    keep_it = np.append(~tx.SPACE[block.buf], False)
    out = buf.copy()
    out[e], keep_it[e] = 32, True
    close = block.end.copy()
    if len(e):
        first, last = tx.per_text(len(block.start), of)
        some = last > first
        close[some] = e[last[some] - 1]
    out[close], keep_it[close] = END, True
    place = np.cumsum(keep_it) - 1
    return out[keep_it], place[close], tx.span_hash(tx.prefix_hash(block.buf), s, e), of


def grams(stream: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each symbol with the ``DEPTH`` before it in its text (end symbols before its start), the latest lowest."""
    starts = np.concatenate(([0], ends[:-1] + 1))
    since = np.arange(len(stream)) - np.repeat(starts, ends - starts + 1)
    code = stream.astype(np.int64)
    for k in range(1, DEPTH + 1):
        before = np.full(len(stream), END, dtype=np.int64)
        before[k:] = stream[: len(stream) - k]
        before[since < k] = END
        code |= before << (8 * k)
    return code


def tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    codes, found = pd.factorize(keys)
    return found, np.bincount(codes, weights=weights, minlength=len(found)).astype(np.int64)


def corpus_counts(documents: DataFrame) -> DataFrame:
    """(kind, key, n): counts of symbol runs and of words, and the number of texts, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {GRAM: [], WORD: []}
        texts = 0

        def merged() -> None:
            for kind, parts in held.items():
                if parts:
                    keys, n = tally(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                    held[kind] = [(keys, n)]

        def handed() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                for keys, n in parts:
                    for at in range(0, len(keys), 1 << 17):
                        part = slice(at, at + (1 << 17))
                        yield tx.batch({"kind": np.full(len(keys[part]), kind, dtype=np.int32), "key": keys[part], "n": n[part]}, COUNTS)
                held[kind] = []

        for one in batches:
            for block in tx.blocks(one["text"], lower=True):
                stream, ends, words, _ = symbols(block)
                texts += len(block.start)
                held[GRAM].append(tally(grams(stream, ends)))
                held[WORD].append(tally(words.view(np.int64)))
                if sum(len(k) for parts in held.values() for k, _ in parts) > HELD:
                    merged()
                    if sum(len(k) for parts in held.values() for k, _ in parts) > HELD // 2:
                        yield from handed()
        merged()
        yield from handed()
        yield tx.batch({"kind": [TEXTS], "key": [0], "n": [texts]}, COUNTS)

    rows = documents.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, tx.spark_schema(COUNTS))
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class Tree:
    """Per context length: kept contexts with the mass left to shorter ones, and listed next symbols with their probability."""

    root: np.ndarray
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    entries: list[np.ndarray]
    chance: list[np.ndarray]

    def probabilities(self, codes: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """Chance of each run's last symbol after its longest kept context of at most ``depth`` symbols."""
        p = self.root[codes & 255]
        inside = np.ones(len(codes), dtype=bool)
        for k in range(1, depth + 1):
            if not len(self.contexts[k - 1]):
                break
            place, inside = find(self.contexts[k - 1], (codes >> 8) & ((1 << 8 * k) - 1), inside)
            listed, known = find(self.entries[k - 1], codes & ((1 << 8 * (k + 1)) - 1), inside)
            p = np.where(inside, self.backoff[k - 1][place] * p, p)
            if known.any():
                p[known] = self.chance[k - 1][listed[known]]
        return p


def find(table: np.ndarray, keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    place = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return place, among & (table[place] == keys)


def grow(counts: DataFrame) -> Tree:
    """The tree from the corpus counts; only contexts and next symbols above the fixed shares leave Spark."""
    runs = counts.where(F.col("kind") == GRAM)
    by_symbol = {r["s"]: r["n"] for r in runs.groupBy(F.col("key").bitwiseAND(255).alias("s")).agg(F.sum("n").alias("n")).collect()}
    total = sum(by_symbol.values())
    c0 = np.array([by_symbol.get(s, 0) for s in range(256)], dtype=np.float64)
    tree = Tree((c0 + DISCOUNT) / (total + 256 * DISCOUNT), [], [], [], [])
    levels = []
    for k in range(1, DEPTH + 1):
        least = max(1.0, P_MIN * total)
        mask = (1 << 8 * (k + 1)) - 1
        listed = runs.groupBy(F.col("key").bitwiseAND(mask).alias("key")).agg(F.sum("n").alias("n"))
        context = F.shiftright("key", 8).alias("context")
        sizes = listed.groupBy(context).agg(F.sum("n").alias("size")).where(F.col("size") >= least)
        got_sizes = sizes.toPandas().sort_values("context", ignore_index=True)
        entries = listed.where(F.col("n") >= max(1.0, LISTED * least)).toPandas().sort_values("key", ignore_index=True)
        levels.append((got_sizes["context"].to_numpy(np.int64), got_sizes["size"].to_numpy(np.float64), entries["key"].to_numpy(np.int64), entries["n"].to_numpy(np.float64)))
    kept = [np.zeros(len(level[0]), dtype=bool) for level in levels]
    shorter = None
    for k, (contexts, sizes, keys, n) in enumerate(levels, 1):
        place, known = find(contexts, keys >> 8, np.ones(len(keys), dtype=bool))
        if shorter is None:
            parent = c0[keys & 255] / max(1.0, total)
        else:
            at, there = find(shorter[2], keys & ((1 << 8 * k) - 1), np.ones(len(keys), dtype=bool))
            up, up_there = find(shorter[0], (keys >> 8) & ((1 << 8 * (k - 1)) - 1), np.ones(len(keys), dtype=bool))
            parent = np.where(there & up_there, shorter[3][at] / np.maximum(shorter[1][up], 1) if len(shorter[1]) else 1.0, 1.0)
        gain = np.where(known, n * np.log(np.maximum(n, 1) / np.maximum(sizes[place] if len(sizes) else 1.0, 1) / np.maximum(parent, 1e-300)), 0.0)
        kept[k - 1] = np.bincount(place[known], weights=gain[known], minlength=len(contexts)) >= DIVERGENCE
        shorter = levels[k - 1]
    for k in range(DEPTH, 1, -1):  # suffixes of kept contexts
        suffix = np.unique(levels[k - 1][0][kept[k - 1]] & ((1 << 8 * (k - 1)) - 1))
        kept[k - 2] |= np.isin(levels[k - 2][0], suffix)
    for k, (contexts, sizes, keys, n) in enumerate(levels, 1):
        own, size = contexts[kept[k - 1]], sizes[kept[k - 1]]
        place, known = find(own, keys >> 8, np.ones(len(keys), dtype=bool))
        keys, n, place = keys[known], n[known], place[known]
        mass = np.bincount(place, weights=n - DISCOUNT, minlength=len(own))
        backoff = 1 - mass / np.maximum(size, 1)
        shorter_chance = tree.probabilities(keys, k - 1)
        tree.contexts.append(own)
        tree.backoff.append(backoff)
        tree.entries.append(keys)
        tree.chance.append((n - DISCOUNT) / size[place] + backoff[place] * shorter_chance if len(keys) else np.zeros(0))
    return tree


def score_documents(documents: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, the token counts and both scores, a row for each input row."""
    counts = keep_table(corpus_counts(training))
    tree = grow(counts)
    words = counts.where(F.col("kind") == WORD)
    n_words, n_different = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_texts = counts.where(F.col("kind") == TEXTS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_all, different = n_words + n_texts, n_different + (n_texts > 0)
    common = words.where(F.col("n") >= max(2.0, COMMON * n_all)).select("key", "n").toPandas().sort_values("key", ignore_index=True)
    shared = documents.sparkSession.sparkContext.broadcast((tree, common["key"].to_numpy(np.int64), common["n"].to_numpy(np.int64)))
    end_log = float(np.log10(n_texts + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_tree, keys, n = shared.value
        log_n = np.log10(n + 1.0)
        for one in batches:
            rows = one["row"].to_numpy()
            for block in tx.blocks(one["text"], lower=True):
                stream, ends, hashes, of = symbols(block)
                codes, different_codes = pd.factorize(grams(stream, ends))
                logs = np.log10(own_tree.probabilities(different_codes))[codes]
                starts = np.concatenate(([0], ends[:-1] + 1))
                place, known = find(keys, hashes.view(np.int64), np.ones(len(hashes), dtype=bool))
                size, row = len(block.start), rows[block.index]
                word_logs = np.bincount(of[known], weights=log_n[place[known]], minlength=size) if known.any() else np.zeros(size)
                common_known = np.bincount(of[known], minlength=size)
                none = np.zeros(size, dtype=np.int64)
                yield tx.batch({"row": row, "doc_id": one["doc_id"].take(pa.array(block.index)), "kind": np.full(size, SUMMARY, np.int32), "key": row, "n": none, "n_tokens": np.bincount(of, minlength=size) + 1, "n_known": common_known + (n_texts > 0), "logs": word_logs + end_log, "score": tx.segment_sums(logs, starts, ends + 1)}, PARTS)
                rare_hashes, rare_of = hashes[~known], of[~known]
                if len(rare_hashes):
                    together, kinds = pd.factorize(rare_hashes ^ tx.mix(rare_of.astype(np.uint64) + tx.U64(1)))
                    first = np.zeros(len(kinds), dtype=np.int64)
                    first[together[::-1]] = np.arange(len(together))[::-1]
                    times = np.bincount(together, minlength=len(kinds))
                    yield pa.RecordBatch.from_arrays([pa.array(row[rare_of[first]]), pa.nulls(len(first), pa.int64()), pa.array(np.full(len(first), WORD, np.int32)), pa.array(rare_hashes[first].view(np.int64)), pa.array(times), *[pa.nulls(len(first), f.type) for f in list(PARTS)[5:]]], schema=PARTS)

    numbered = documents.withColumn("row", F.monotonically_increasing_id())
    parts = numbered.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(score, tx.spark_schema(PARTS))
    seen = words.select(F.col("kind").alias("k"), F.col("key").alias("w"), F.col("n").alias("c"))
    joined = parts.join(seen, (parts["kind"] == seen["k"]) & (parts["key"] == seen["w"]), "left")
    total_log = float(np.log10(n_all + different + 1))
    summed = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0))).alias("n_known"),
        (F.sum("logs") + F.sum(F.when(F.col("c").isNotNull(), F.col("n") * F.log10(F.col("c") + 1)).otherwise(0.0)) - F.sum("n_tokens") * F.lit(total_log)).alias("base_score"),
        F.sum("score").alias("score"),
    )
    return summed.drop("row").withColumn("train_tokens", F.lit(n_all).cast("long"))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", held_out().alias("held_out"))
    scored = score_documents(documents, documents.where(~F.col("held_out")))
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
