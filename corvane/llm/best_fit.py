"""Vector best-fit packing: whole documents into sequences under token, document-count and attention-cost capacities.

A document's ids end with an end id; only a document longer than a sequence is cut,
into pieces of a full sequence's length, of which the first may be shorter.  A piece
of n tokens takes n tokens, one document and n * n units of attention cost.  Pieces
are dealt in turn to pools of about ``POOL`` documents, whatever the table's
partitions, and each pool is packed by itself: pieces go from the longest to the
shortest, each into the open sequence that all three residual capacities allow and
that is left with the smallest weighted norm of its residuals (as shares of the
capacities).  With ``measure="dot"`` one sequence is filled at a time, with the piece
that fits and has the largest weighted dot product with the residuals.  A full piece
is a sequence of its own.

Only a piece's place, length and checksum are shuffled, not its ids.  A pool ends with one
sequence that may be half empty, one in some thousands.

Defined results: a null or empty text is the end id alone; repeated rows are packed
one by one; ties go to the sequence opened first, and pieces of one length are
placed in the order of their ids, a missing id first; an empty table gives no
pieces.  Other columns are not carried, whatever their names.  A task holds the ids
of one whole text, 4 bytes a token, whatever the text's length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import text as tx
from .packing import encoder
from .tables import read

END_ID = 2
LENGTH = 1024
#: Documents that share a sequence, and its attention cost: no fewer than whole tokens allow.
DOCUMENTS = 1024
COST = LENGTH * LENGTH
#: Weights of tokens, documents and attention cost.
WEIGHTS = (1.0, 0.001, 0.01)
#: Documents of a pool.
POOL = 8192

CUT = tx.arrow_schema(doc_id=pa.int64(), piece=pa.int32(), start=pa.int64(), length=pa.int64(), ids_crc32=pa.int64(), pool=pa.int32())
PLACED = tx.arrow_schema(doc_id=pa.int64(), piece=pa.int32(), start=pa.int64(), length=pa.int64(), ids_crc32=pa.int64(), sequence_id=pa.int64(), offset=pa.int64())


def demands(lengths: np.ndarray) -> np.ndarray:
    return np.stack([lengths, np.ones_like(lengths), lengths * lengths], axis=1)


def by_norm(lengths: np.ndarray, limits: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sequence of each piece, pieces given from the longest on: the smallest norm of what is left."""
    scale = weights / limits.astype(float) ** 2
    room, number = np.empty((len(lengths), 3), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    out, opened, held = np.empty(len(lengths), dtype=np.int64), 0, 0
    least = demands(lengths[-1:])[0]
    for k, need in enumerate(demands(lengths)):
        left = room[:held] - need
        norm = np.where((left >= 0).all(axis=1), (left * left) @ scale, np.inf)
        best = int(norm.argmin()) if held else -1
        if best < 0 or norm[best] == np.inf:
            best, held = held, held + 1
            room[best], number[best] = limits, opened
            opened += 1
        room[best] -= need
        out[k] = number[best]
        if (room[best] < least).any():  # not even the shortest fits any more
            room[best : held - 1], number[best : held - 1] = room[best + 1 : held].copy(), number[best + 1 : held].copy()
            held -= 1
    return out


def by_dot(lengths: np.ndarray, limits: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sequence of each piece, pieces given from the longest on: one sequence is filled at a time, by the largest dot product."""
    sizes, first, count = np.unique(lengths, return_index=True, return_counts=True)
    need, limits = demands(sizes), limits.astype(np.int64)
    scale = weights / limits.astype(float) ** 2
    out, used, opened = np.empty(len(lengths), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64), 0
    for _ in range(len(lengths)):
        if opened == 0 or (best := _next(need, room, used < count, scale)) < 0:
            room, opened = limits.copy(), opened + 1
            best = _next(need, room, used < count, scale)
        out[first[best] + used[best]] = opened - 1
        used[best] += 1
        room -= need[best]
    return out


def _next(need: np.ndarray, room: np.ndarray, there: np.ndarray, scale: np.ndarray) -> int:
    product = np.where(there & (need <= room).all(axis=1), need @ (room * scale), -1.0)
    best = int(product.argmax())
    return best if product[best] >= 0 else -1


MEASURES = {"norm": by_norm, "dot": by_dot}


def cut_documents(documents: DataFrame, tokenizer_path: str, length: int, pools: int) -> DataFrame:
    """A row for each piece, dealt to the pools in turn."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path), np.array([END_ID], dtype="<u4").tobytes()
        # full pieces and others are dealt apart, each task from a pool of its own on
        turn = [int(tx.mix(np.array([TaskContext.get().partitionId() + 1], dtype=np.uint64))[0] % tx.U64(pools))] * 2
        rows: dict[str, list] = {f.name: [] for f in CUT}
        for one in batches:
            for doc, text in zip(one["doc_id"], one["text"], strict=True):
                ids = memoryview(encode(text.as_py() or "") + end)
                n = len(ids) // 4
                at = 0
                for piece in range(-(-n // length)):
                    size = (n - 1) % length + 1 if piece == 0 else length
                    full = size == length
                    for name, value in (("doc_id", doc.as_py()), ("piece", piece), ("start", at), ("length", size), ("ids_crc32", zlib.crc32(ids[4 * at : 4 * (at + size)])), ("pool", turn[full] % pools)):
                        rows[name].append(value)
                    turn[full] += 1
                    at += size
                if len(rows["doc_id"]) >= 4096:
                    yield tx.batch(rows, CUT)
                    for v in rows.values():
                        v.clear()
        yield tx.batch(rows, CUT)

    return documents.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(cut, tx.spark_schema(CUT))


def best_fit_documents(
    documents: DataFrame, tokenizer_path: str, length: int = LENGTH, documents_limit: int = DOCUMENTS, cost_limit: int = COST, weights: tuple[float, float, float] = WEIGHTS, measure: str = "norm", pools: int | None = None
) -> DataFrame:
    """A row for each piece: its document, number and place there, checksum of its ids, sequence, and place in it.

    ``pools`` defaults to one for each ``POOL`` rows of the table, which are counted for it.
    """
    if cost_limit < length * length or documents_limit < 1:
        raise ValueError("a full piece has to fit into a sequence by itself")
    limits, shares, choose = np.array([length, documents_limit, cost_limit], dtype=np.int64), np.array(weights, dtype=float), MEASURES[measure]
    pools = pools or max(1, math.ceil(documents.count() / POOL))

    def place(table: pa.Table) -> pa.Table:
        doc, piece, sizes, crc = (table[c].to_numpy() for c in ("doc_id", "piece", "length", "ids_crc32"))
        order = np.lexsort((crc, piece, np.nan_to_num(doc, nan=-math.inf), -sizes))
        sizes = sizes[order]
        whole = int(np.searchsorted(-sizes, -length, side="right"))
        sequence = np.arange(len(sizes))
        if whole < len(sizes):
            sequence[whole:] = whole + choose(sizes[whole:], limits, shares)
        by = np.argsort(sequence, kind="stable")
        before = np.cumsum(sizes[by]) - sizes[by]
        new = np.concatenate(([True], np.diff(sequence[by]) > 0))
        offset = np.empty(len(sizes), dtype=np.int64)
        offset[by] = before - np.repeat(before[new], np.diff(np.append(np.flatnonzero(new), len(sizes))))
        base = int(table["pool"][0].as_py()) << 40
        kept = table.take(pa.array(order)).select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return kept.append_column("sequence_id", pa.array(base + sequence)).append_column("offset", pa.array(offset))

    return cut_documents(documents, tokenizer_path, length, pools).groupBy("pool").applyInArrow(place, tx.spark_schema(PLACED))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
