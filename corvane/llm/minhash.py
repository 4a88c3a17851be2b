"""Near-duplicate documents by SuperMinHash, banding, verification and components.

*Signatures.*  Every shingle draws a random permutation of the signature's slots
step by step, and a rank for each step that grows with the step's number.  A slot
keeps its smallest rank; once all slots are filled by earlier steps, later ones
can change nothing, and the drawing stops.  Many texts are drawn together.

*Candidates.*  Documents with equal shingle sets form one class, and only its
representative goes on.  Slots are hashed in bands; representatives that share a
band meet in a bucket.  In each bucket the member that meets the most others
overall, the hub, is compared with all members on full shingle sets.  Members of
a bucket that do not end up in one component are then compared across components,
in pairs of blocks of bounded size; pairs that are not linked never become rows,
and no group is gathered in one task.

With ``BANDS`` bands of ``ROWS`` slots a pair of similarity 0.8 shares no band
with a chance of 8e-6, and one of similarity 0.1 shares one with a chance of 6e-7.

Defined results: null and empty texts have an empty set, link with nothing and
stay; repeated rows of one id, which have one text, count once and are each
returned; rows without an id take no part, have no component and stay; an empty
table gives no rows; other columns are not carried, whatever their names.  A task
holds one whole text and some 60 bytes for each of its bytes at a time, whatever the
text's length; comparisons across components hold two blocks of at most ``CLUSTER_BLOCK``
texts and about ``BLOCK_SHINGLES`` shingles, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .components import components
from .tables import keep, read, small_batches, with_ids

BANDS = 64
ROWS = 8
SLOTS = BANDS * ROWS
SIMILAR_PERCENT = 80
#: Members of a hub that a task compares with it.
MEMBERS = 1000
#: Shingles whose permutations are drawn together.
TOGETHER = 1 << 13
#: Documents of a block, and different shingles of a stripe, in comparisons by matrix products.
CLUSTER_BLOCK = 256
BLOCK_SHINGLES = 1 << 20
STRIPE = 1 << 14

SETS = tx.arrow_schema(doc_id=pa.int64(), n_shingles=pa.int64(), set_a=pa.int64(), set_b=pa.int64(), bands=pa.list_(pa.int64()))
PAIRS = tx.arrow_schema(a=pa.int64(), b=pa.int64())

_STEP = tx.U64(0x9E3779B97F4A7C15)
_EMPTY = tx.U64(0xFFFFFFFFFFFFFFFF)
_LOW = tx.U64(0xFFFFFFFF)


def shingle_sets(block: tx.Block, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words make one shingle."""
    s, e, of = block.words()
    h = tx.span_hash(tx.prefix_hash(block.buf), s, e)
    first, last = tx.per_text(len(block.start), of)
    runs = h[: max(0, len(h) - size + 1)].copy()
    for k in range(1, size):
        runs = tx.mix(runs * tx.U64(0xD6E8FEB86659FD93) + h[k : len(h) - size + 1 + k])
    for i in range(len(block.start)):
        n = last[i] - first[i]
        if n >= size:
            yield np.unique(runs[first[i] : last[i] - size + 1])
        elif n:
            short = np.array([n], dtype=np.uint64)
            for k in range(first[i], last[i]):
                short = tx.mix(short * tx.U64(0xD6E8FEB86659FD93) + h[k : k + 1])
            yield short
        else:
            yield np.zeros(0, dtype=np.uint64)


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures of several non-empty sets, a row each."""
    n = len(sets)
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    signature = np.full(n * slots, _EMPTY, dtype=np.uint64)
    order, rows = None, None
    for step in range(slots):
        draw = tx.mix(items + tx.U64((step + 1) * int(_STEP) % (1 << 64)))
        pick = step + ((draw & _LOW) * tx.U64(slots - step) >> tx.U64(32)).astype(np.int64)
        if step == 0:
            slot = pick
        else:
            place = rows + pick
            slot = order[place].astype(np.int64)
            order[place] = order[rows + step]
        np.minimum.at(signature, owner * slots + slot, (tx.U64(step) << tx.U64(32)) | (draw >> tx.U64(32)))
        open_sets = signature.reshape(n, slots).max(axis=1) == _EMPTY
        if not open_sets.any():
            break
        going = open_sets[owner]
        if step == 0:
            items, owner, pick = items[going], owner[going], pick[going]
            order = np.tile(np.arange(slots, dtype=np.uint16), len(items))
            rows = np.arange(len(items)) * slots
            order[rows + pick] = 0
        elif going.sum() < 0.7 * len(going):
            items, owner = items[going], owner[going]
            order = order.reshape(-1, slots)[going].ravel()
            rows = np.arange(len(items)) * slots
    return signature.reshape(n, slots)


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signatures.shape[1] // bands
    place = np.arange(rows, dtype=np.uint64) * _STEP
    inner = tx.mix(signatures.reshape(len(signatures), bands, rows) * tx.U64(0xD6E8FEB86659FD93) + place).sum(axis=2, dtype=np.uint64)
    return tx.mix(inner + np.arange(1, bands + 1, dtype=np.uint64) * _STEP).view(np.int64)


def signed_sets(documents: DataFrame, size: int) -> DataFrame:
    """Per document: set size, a 128-bit digest of the set, and its band keys (none for an empty set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            ids = one["doc_id"]
            for block in tx.blocks(one["text"], lower=True):
                sets = list(shingle_sets(block, size))
                bands: list = [None] * len(sets)
                held: list[int] = []
                for i, x in enumerate(sets):
                    if len(x):
                        held.append(i)
                    if held and (i + 1 == len(sets) or sum(len(sets[k]) for k in held) >= TOGETHER):
                        for k, keys in zip(held, band_keys(super_minhash([sets[k] for k in held])), strict=True):
                            bands[k] = keys
                        held = []
                digest = np.array([(tx.mix(x).sum(dtype=np.uint64), tx.mix(x ^ _STEP).sum(dtype=np.uint64)) for x in sets], dtype=np.uint64).view(np.int64)
                yield tx.batch({"doc_id": ids.slice(int(block.index[0]), len(sets)), "n_shingles": [len(x) for x in sets], "set_a": digest[:, 0], "set_b": digest[:, 1], "bands": bands}, SETS)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(sign, tx.spark_schema(SETS))


def linked(pairs: DataFrame, documents: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough.

    A hub's members are dealt to parts of about ``MEMBERS``, and every text is a row of
    its own: each part streams its hub's text once and then its members'.
    """

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub_set = np.zeros(0, dtype=np.uint64)
        for one in batches:
            is_hub, good = one["b"].is_null().to_numpy(zero_copy_only=False), []
            for block in tx.blocks(one["text"], lower=True):
                for i, own in zip(block.index, shingle_sets(block, size), strict=True):
                    if is_hub[i]:
                        hub_set = own
                        continue
                    both = len(np.intersect1d(hub_set, own, assume_unique=True))
                    if 100 * both >= percent * (len(hub_set) + len(own) - both) and both:
                        good.append(int(i))
            yield tx.batch({"a": one["a"].take(pa.array(good, pa.int64())), "b": one["b"].take(pa.array(good, pa.int64()))}, PAIRS)

    ids = keep(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    texts = with_ids(documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text")), ids, "id")
    parts = keep(pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts")))
    placed = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    members = placed.join(texts.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "text")
    hubs = parts.join(texts.withColumnRenamed("id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    dealt = hubs.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return dealt.select("a", "b", "text").mapInArrow(confirm, tx.spark_schema(PAIRS))


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all of y."""
    _, codes = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    rows = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    out = np.zeros((len(x), len(y)), dtype=np.float32)
    order = np.argsort(codes, kind="stable")
    rows, codes = rows[order], codes[order]
    for at in range(0, int(codes[-1]) + 1 if len(codes) else 0, STRIPE):
        a, z = np.searchsorted(codes, (at, at + STRIPE))
        held = np.zeros((len(x) + len(y), min(STRIPE, int(codes[z - 1]) + 1 - at)), dtype=np.float32)
        held[rows[a:z], codes[a:z] - at] = 1
        out += held[: len(x)] @ held[len(x) :].T
    return out


def links_across(able: DataFrame, documents: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between different components among the documents that meet in mixed buckets.

    Documents that meet directly or by others form a cluster.  A cluster is cut
    into blocks; each pair of blocks is compared in one task by matrix products,
    and of the links found, one for each document and other component comes out.
    """
    low = able.groupBy("key").agg(F.min("doc_id").alias("low"))
    clusters = components(able.join(low, "key").select("doc_id", "low"), "doc_id", "low").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    named = able.groupBy("doc_id").agg(F.first("component").alias("component"), F.max("n_shingles").alias("n_shingles"))
    blocks = F.ceil(F.greatest(F.count("*") / CLUSTER_BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = named.join(clusters, "doc_id").groupBy("cluster").agg(blocks.alias("blocks"))
    placed = keep(named.drop("n_shingles").join(clusters, "doc_id").join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")))
    texts = with_ids(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), placed.select("doc_id"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = placed.join(texts, "doc_id").select("doc_id", "component", "cluster", "block", "text", other)
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")

    def compare(key: tuple, one: pd.DataFrame) -> pd.DataFrame:
        found = []
        x, y = one[one["block"] == key[1]], one[one["block"] == key[2]]
        if len(x) and len(y):
            sets = [[s for block in tx.blocks(pa.array(part["text"], pa.binary()), lower=True) for s in shingle_sets(block, size)] for part in (x, y)]
            both = shared_counts(*sets)
            total = np.array([len(s) for s in sets[0]])[:, None] + np.array([len(s) for s in sets[1]])[None, :]
            cx, cy, ix, iy = x["component"].to_numpy(), y["component"].to_numpy(), x["doc_id"].to_numpy(), y["doc_id"].to_numpy()
            p, q = np.nonzero((100 * both >= percent * (total - both)) & (both > 0) & (cx[:, None] != cy[None, :]))
            seen = set()
            for i, j in zip(p, q, strict=True):
                if (i, cy[j]) not in seen:
                    seen.add((i, cy[j]))
                    found.append((ix[i], iy[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("cluster", "i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    small_batches(documents.sparkSession)
    known = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    sets = keep(signed_sets(documents, size))
    classes = keep(sets.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")))
    signed = sets.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n_shingles", F.explode("bands").alias("key"))
    shared = signed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = keep(signed.join(shared, "key"))
    degree = members.groupBy("doc_id").agg(F.sum("size").alias("meets"))
    met = members.join(degree, "doc_id")
    hubs = met.groupBy("key").agg(F.max(F.struct("meets", (-F.col("doc_id")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("hub"))
    first = keep(members.join(hubs, "key").where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct())
    links = keep(linked(first, known, size, percent))
    group = components(links, "a", "b")

    labelled = members.where("size > 2").join(group, members["doc_id"] == group["node"], "left").select("key", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    apart = keep(labelled.join(mixed, "key"))
    if not apart.isEmpty():
        more = keep(links_across(apart, known, size, percent))
        if not more.isEmpty():
            # the components so far stand for their links
            stars = group.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
            group = components(stars.unionByName(more), "a", "b")

    named = classes.join(group, classes["rep"] == group["node"], "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component_id"))
    placed = sets.join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), size=2)
