"""Token pairs of two tokenizers that overlap in the same text, counted over the corpus.

A text's two rows of tokens spell the same bytes.  Places where a token ends in both
cut them into groups; a link is a pair of token occurrences that share bytes, and
is one stretch between neighbouring ends of either kind.

1. Every task aligns its documents and adds up the links of each id pair.
2. The distinct pairs get numbers from a minimal perfect hash that Spark builds bucket by bucket.
3. Every task's sums become dense vectors indexed by these numbers, in blocks of
   ``BLOCK`` counts; blocks of one place are added in a tree of fan-in ``FAN``,
   so no task holds more than ``FAN`` of them, however frequent a pair is.
4. A second pass aligns the documents again and looks up its pairs' counts by hash, against the keys kept with it.

The hash, keys and counts go to every executor only up to ``BROADCAST_PAIRS`` pairs,
some 100 bytes for six of them.  Beyond, the counts stay a table, and each document's
distinct pairs are joined to it by shuffles.

Defined results: a null or empty text, and one whose tokens of either kind don't spell
it, has no tokens and counts nowhere; repeated rows count each and are each returned, and so
are rows without an id; ties of a B id's best count all count; an empty table gives no
rows; other columns are not carried, whatever their names.  A task holds one whole
text, its tokens and some 200 bytes for each of them, whatever the text's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .packing import byte_symbols, encoder
from .perfect_hash import PerfectHash, build, spread
from .tables import keep_table, read, small_batches

#: Pairs up to which hash, keys and counts go to every executor.
BROADCAST_PAIRS = 8_000_000
#: Keys of a bucket of the hash, on average.
BUCKET = 1 << 15
#: Counts of a block of a dense vector, and vectors that a node of the tree adds.
BLOCK = 1 << 13
FAN = 16
#: Bytes of texts that are aligned together, and distinct pairs that a task holds before it hands them on.
TOGETHER = 1 << 19
HELD = 1 << 21

COUNTS = tx.arrow_schema(key=pa.int64(), spread=pa.int64(), count=pa.int64())
VECTORS = tx.arrow_schema(block=pa.int64(), node=pa.int64(), counts=pa.binary())
ALIGNED = tx.arrow_schema(doc_id=pa.int64(), n_a=pa.int64(), n_b=pa.int64(), n_groups=pa.int64(), n_links=pa.int64(), groups=pa.string())
SCORED = tx.arrow_schema(**{f.name: f.type for f in ALIGNED}, n_best=pa.int64(), count_sum=pa.int64())
LINKED = tx.arrow_schema(**{f.name: f.type for f in ALIGNED}, keys=pa.list_(pa.int64()), times=pa.list_(pa.int64()))


@dataclass
class Aligned:
    """Texts in a row: of text i, A tokens ``a[i]:a[i + 1]``, and so on; ``closes``: whether a group ends at a byte; ``key`` of each link."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    end_a: np.ndarray
    end_b: np.ndarray
    a: np.ndarray
    b: np.ndarray
    groups: np.ndarray
    links: np.ndarray
    closes: np.ndarray
    key: np.ndarray


class Pairing:
    """Both tokenizers with the bytes of each token; a space is put before the text."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        self.encode = encoder(byte_path, plain=True)
        symbols = byte_symbols()
        vocab = self.encode.whole.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(map(symbols.__getitem__, token)) if all(c in symbols for c in token) else token.encode()
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.n_b = self.pieces.get_piece_size()
        names = self.pieces.id_to_piece(list(range(self.n_b)))
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.pieces.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.length_a, self.length_b = (np.array([len(x) for x in have], dtype=np.int64) for have in (self.bytes_a, self.bytes_b))
        self.texts_a = np.array([f"{i}{s}" for s in ",|" for i in range(len(self.bytes_a))], dtype=object)
        self.texts_b = np.array([f"{i}{s}" for s in (",", ";", "") for i in range(self.n_b)], dtype=object)

    def align(self, texts: list[str | None]) -> Aligned:
        none = np.zeros(0, dtype=np.int64)
        a, b, size = [none] * len(texts), [none] * len(texts), np.zeros(len(texts), dtype=np.int64)
        there = [i for i, t in enumerate(texts) if t]
        for i, in_b in zip(there, self.pieces.encode([texts[i] for i in there], num_threads=1), strict=True):
            in_a = np.frombuffer(self.encode(" " + texts[i]), dtype="<u4").astype(np.int64)
            whole = (" " + texts[i]).encode()
            # byte-level merging keeps the order of bytes and adds none: it spells the text if it has its length
            if int(self.length_a[in_a].sum()) == len(whole) and b"".join(map(self.bytes_b.__getitem__, in_b)) == whole:
                a[i], b[i], size[i] = in_a, np.fromiter(in_b, dtype=np.int64, count=len(in_b)), len(whole)
        ids_a, ids_b = np.concatenate([none, *a]), np.concatenate([none, *b])
        end_a, end_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        is_a, is_b = (np.zeros(int(size.sum()) + 1, dtype=bool) for _ in range(2))
        is_a[end_a], is_b[end_b] = True, True
        links, closes = np.flatnonzero(is_a | is_b), is_a & is_b
        ends = np.concatenate(([0], np.cumsum(size)))
        bounds = [np.searchsorted(x, ends, side="right") for x in (end_a, end_b, np.flatnonzero(closes), links)]
        # a stretch belongs to the tokens that end at or after its end
        key = ids_a[np.cumsum(is_a)[links] - is_a[links]] * self.n_b + ids_b[np.cumsum(is_b)[links] - is_b[links]] if len(links) else none
        return Aligned(ids_a, ids_b, end_a, end_b, *bounds, closes, key)

    def groups(self, x: Aligned) -> list[str]:
        """Of each text: its groups as ``a1,a2|b1;a3|b2,b3``."""
        last_a, last_b = x.closes[x.end_a], x.closes[x.end_b]  # the last token of a group of either kind
        ga, gb = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        until_a, until_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        out = np.empty(len(x.ids_a) + len(x.ids_b), dtype=object)
        mark = last_b.astype(np.int64)
        mark[x.b[1:][np.diff(x.b) > 0] - 1] = 2
        if len(out):
            out[np.arange(len(ga)) + np.append(0, until_b[:-1])[ga]] = self.texts_a[x.ids_a + last_a * len(self.bytes_a)]
            out[np.arange(len(gb)) + until_a[gb]] = self.texts_b[x.ids_b + mark * self.n_b]
        at, out = x.a + x.b, out.tolist()
        return ["".join(out[p:q]) for p, q in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_PAIRINGS: dict[tuple[str, str], Pairing] = {}


def pairing(byte_path: str, piece_path: str) -> Pairing:
    """One pair of tokenizers for each Python worker and files."""
    if (byte_path, piece_path) not in _PAIRINGS:
        _PAIRINGS[byte_path, piece_path] = Pairing(byte_path, piece_path)
    return _PAIRINGS[byte_path, piece_path]


def together(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of some half a megabyte, with the place of the first."""
    held, first, size = [], 0, 0
    for i, text in enumerate(column):
        one = text.as_py()
        if held and size + len(one or "") > TOGETHER:
            yield first, held
            held, first, size = [], i, 0
        held.append(one)
        size += len(one or "")
    if held:
        yield first, held


def given(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def pair_counts(documents: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(key, spread, count): the links of each id pair, added up within each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pairing(byte_path, piece_path)
        keys, counts, new = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), []

        def added() -> tuple[np.ndarray, np.ndarray]:
            found, place = np.unique(np.concatenate([keys, *(k for k, _ in new)]), return_inverse=True)
            total = np.zeros(len(found), dtype=np.int64)
            np.add.at(total, place, np.concatenate([counts, *(n for _, n in new)]))
            return found, total

        for one in batches:
            for _, texts in together(one["text"]):
                new.append(np.unique(pair.align(texts).key, return_counts=True))
                if sum(len(k) for k, _ in new) > max(1 << 18, len(keys)):
                    keys, counts = added()
                    new = []
                    if len(keys) > HELD:
                        yield tx.batch({"key": keys, "spread": spread(keys), "count": counts}, COUNTS)
                        keys, counts = keys[:0], counts[:0]
        keys, counts = added()
        yield tx.batch({"key": keys, "spread": spread(keys), "count": counts}, COUNTS)

    return given(documents).select("text").mapInArrow(count, tx.spark_schema(COUNTS))


def hash_of(distinct: DataFrame, n: int) -> PerfectHash:
    """The minimal perfect hash of n distinct (key, spread), built bucket by bucket."""
    buckets = -(-n // BUCKET)

    def one(table: pa.Table) -> pa.Table:
        keys = np.sort(table["key"].to_numpy())
        sizes, words, ordered = build(keys)
        return pa.table({"bucket": [int(table["bucket"][0].as_py())], "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": [words.tobytes()], "keys": [ordered.astype(np.int64).tobytes()]})

    made = distinct.withColumn("bucket", F.col("spread") % F.lit(buckets)).groupBy("bucket").applyInArrow(one, "bucket long, sizes array<long>, bits binary, keys binary")
    return PerfectHash.of(buckets, [(r["bucket"], r["sizes"], r["bits"], r["keys"]) for r in made.toArrow().to_pylist()])


def tree_sum(sparse: DataFrame, number: PerfectHash) -> np.ndarray:
    """The count of each number: dense vectors of the tasks, added in a tree."""
    n = len(number.keys)
    hashed = sparse.sparkSession.sparkContext.broadcast(number)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(-(-n // BLOCK) * BLOCK, dtype=np.int64)
        for one in batches:
            slot = hashed.value(one["key"].to_numpy())
            if (slot < 0).any():
                raise ValueError("a pair came up that the hash was not built from")
            np.add.at(total, slot, one["count"].to_numpy())
        rows = total.reshape(-1, BLOCK)
        used = np.flatnonzero(rows.any(axis=1))
        node = np.full(len(used), TaskContext.get().partitionId())
        yield tx.batch({"block": used, "node": node, "counts": [rows[k].tobytes() for k in used]}, VECTORS)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, dtype=np.int64)
        for x in table["counts"]:
            total += np.frombuffer(x.as_py(), dtype=np.int64)
        return pa.table({"block": table["block"].slice(0, 1), "node": pa.array([table["node"][0].as_py() // FAN], pa.int64()), "counts": [total.tobytes()]})

    vectors, nodes = sparse.mapInArrow(dense, tx.spark_schema(VECTORS)), sparse.rdd.getNumPartitions()
    while True:
        vectors = vectors.groupBy("block", F.floor(F.col("node") / FAN)).applyInArrow(add, tx.spark_schema(VECTORS))
        nodes = -(-nodes // FAN)
        if nodes <= 1:
            break
    out = np.zeros(-(-n // BLOCK) * BLOCK, dtype=np.int64)
    for r in vectors.toArrow().to_pylist():  # n counts, within BROADCAST_PAIRS
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += np.frombuffer(r["counts"], dtype=np.int64)
    hashed.destroy()
    return out[:n]


def totals(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the integers between neighbouring bounds."""
    return np.diff(np.concatenate(([0], np.cumsum(values)))[bounds])


def looked_up(documents: DataFrame, byte_path: str, piece_path: str, number: PerfectHash, counts: np.ndarray, n_b: int) -> DataFrame:
    """The second pass, with counts in every executor."""
    top = np.zeros(n_b, dtype=np.int64)
    np.maximum.at(top, number.keys % n_b, counts)
    sent = documents.sparkSession.sparkContext.broadcast((number, counts, counts == top[number.keys % n_b]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, (number, counts, best) = pairing(byte_path, piece_path), sent.value
        for one in batches:
            for first, texts in together(one["text"]):
                x = pair.align(texts)
                keys, place = np.unique(x.key, return_inverse=True)
                slot = number(keys)
                if (slot < 0).any():
                    raise ValueError("a pair came up that the first pass did not see")
                slot = slot[place]
                rows = {"doc_id": one["doc_id"].slice(first, len(texts)), "n_a": np.diff(x.a), "n_b": np.diff(x.b), "n_groups": np.diff(x.groups), "n_links": np.diff(x.links), "groups": pair.groups(x)}
                yield tx.batch(rows | {"n_best": totals(best[slot], x.links), "count_sum": totals(counts[slot], x.links)}, SCORED)

    return given(documents).mapInArrow(score, tx.spark_schema(SCORED))


def joined(documents: DataFrame, byte_path: str, piece_path: str, sparse: DataFrame, n_b: int) -> DataFrame:
    """The second pass, with counts as a table: for any number of pairs."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pairing(byte_path, piece_path)
        for one in batches:
            for first, texts in together(one["text"]):
                x = pair.align(texts)
                keys, times = zip(*(np.unique(x.key[p:q], return_counts=True) for p, q in zip(x.links[:-1], x.links[1:], strict=True)), strict=True)
                rows = {"doc_id": one["doc_id"].slice(first, len(texts)), "n_a": np.diff(x.a), "n_b": np.diff(x.b), "n_groups": np.diff(x.groups), "n_links": np.diff(x.links), "groups": pair.groups(x)}
                yield tx.batch(rows | {"keys": list(keys), "times": list(times)}, LINKED)

    counts = sparse.groupBy("key").agg(F.sum("count").alias("count")).withColumn("b", F.col("key") % n_b)
    counts = keep_table(counts)
    # a row for each B id
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    counts = keep_table(counts.join(F.broadcast(top), "b").select("key", "count", (F.col("count") == F.col("top")).alias("best")))
    rows = keep_table(given(documents).mapInArrow(link, tx.spark_schema(LINKED)).withColumn("row", F.monotonically_increasing_id()))
    links = rows.select("row", F.explode(F.arrays_zip("keys", "times")).alias("link")).select("row", F.col("link.keys").alias("key"), F.col("link.times").alias("times"))
    sums = links.join(counts, "key").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    none = F.lit(0).cast("long")
    return rows.drop("keys", "times").join(sums, "row", "left").drop("row").withColumns({c: F.coalesce(c, none) for c in ("n_best", "count_sum")})


def align_documents(documents: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, n_best and count_sum, a row for each input row."""
    import sentencepiece

    small_batches(documents.sparkSession)
    n_b = sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()
    sparse = keep_table(pair_counts(documents, byte_path, piece_path))
    distinct = keep_table(sparse.select("key", "spread").distinct())
    n = distinct.count()
    if n > BROADCAST_PAIRS:
        return joined(documents, byte_path, piece_path, sparse, n_b)
    number = hash_of(distinct, n)
    return looked_up(documents, byte_path, piece_path, number, tree_sum(sparse, number), n_b)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = align_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
