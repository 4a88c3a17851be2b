"""Vector bin packing of tokenised documents into training sequences.

Examples are placed under simultaneous limits on tokens, segments and
loss-bearing tokens.  Of the pieces that fit, the open sequence takes the one
with the largest dot product of its demand with the room that is left, both as
shares of the limits; when none fits, the piece with the largest product is cut
to fill what is left.  Whole sequences' worth of a long document
become sequences of their own.  Each Spark task packs the documents that it
reads, so nothing is shuffled, and holds a bounded pool of pieces; what is left
in a task's last open sequence is cut into sequences whose lengths are powers of
two, which need no padding.

A token bears loss if it belongs to the text, not to its prompt, and isn't the
first of its segment, which is predicted from nothing.  Without prompts a sequence
of n tokens bears at most n - 1, so a limit of one token less than the length
never binds then; with prompts, or a lower limit, it does.

Defined results: a null or empty text is the end id alone, and a null prompt is
empty; repeated rows are packed one by one, ties of the dot product by order of
arrival; rows without an id are packed as others; an empty table gives no pieces.
Other columns are not carried, whatever their names.  A task holds the ids of one
whole text beside its pool, 4 bytes a token, whatever the text's length.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .tables import read

END_ID = 1
LENGTH = 2048
MAX_SEGMENTS = 128
MAX_LOSS = 2047
#: Pieces that wait in a task; the heuristic chooses among them.
POOL = 256

PIECES = tx.arrow_schema(doc_id=pa.int64(), start=pa.int64(), length=pa.int64(), ids_crc32=pa.int64(), doc_tokens=pa.int64(), sequence_id=pa.int64(), offset=pa.int64(), loss_tokens=pa.int64())


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: How byte-level vocabularies part a text before merging; a fixed value of their file format.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def merge_ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes of each token and its rank, if merging by rank gives the file's own encoding.

    That is so for plain byte-level merges without normalisation whose merges are
    listed in the order of their tokens' ids; None for other files.
    """
    model, parts = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") in (None, "BPE") and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec.get("normalizer") or parts.get("type") != "ByteLevel" or parts.get("add_prefix_space") or parts.get("use_regex") is False:
        return None
    vocab, symbols = model["vocab"], byte_symbols()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab.get(a + b) for a, b in pairs]
    if None in made or made != sorted(set(made)):
        return None
    special = {t["content"] for t in spec.get("added_tokens", ())}
    own = {token: i for token, i in vocab.items() if token not in special}
    if len(own) != len(made) + 256 or max(own[c] for c in symbols) >= min(made) or not all(c in symbols for token in own for c in token):
        return None
    return {bytes(symbols[c] for c in token): i for token, i in own.items()}


class Encoder:
    """Token ids of a vocabulary file, as the tokenizers library gives them, as 32-bit little-endian bytes.

    Where merging by rank is the same (see ``merge_ranks``), ``tiktoken`` does it, in
    a third of the time; texts with a special token's string or with very long white
    space, on which its pattern runs out of stack, and all texts of other files go
    through ``tokenizers``.  ``plain``: strings of special tokens in a text are text.
    """

    BLANK = re.compile(r"\s{10000}")

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [] if plain else sorted(t["content"] for t in spec.get("added_tokens", ()))
        self.whole, self.by_rank = Tokenizer.from_file(path), None
        self.whole.encode_special_tokens = plain
        ranks = merge_ranks(spec)
        if ranks is not None:
            import tiktoken

            self.by_rank = tiktoken.Encoding("ranks", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        if self.by_rank is None or any(s in text for s in self.special) or self.BLANK.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        ids = array("I", self.by_rank(text))
        return ids.tobytes() if sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, plain: bool = False) -> Encoder:
    """One encoder for each Python worker, file and kind."""
    if (path, plain) not in _ENCODERS:
        _ENCODERS[path, plain] = Encoder(path, plain)
    return _ENCODERS[path, plain]


@dataclass
class Piece:
    doc: object
    start: int
    ids: bytes
    doc_tokens: int
    prompt: int = 0

    @property
    def tokens(self) -> int:
        return len(self.ids) // 4

    @property
    def loss(self) -> int:
        return max(0, self.start + self.tokens - max(self.start + 1, self.prompt))

    def fitting(self, tokens: int, loss: int) -> int:
        """How many of its first tokens fit."""
        return min(self.tokens, tokens, loss + max(self.start + 1, self.prompt) - self.start)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[: 4 * n], self.doc_tokens, self.prompt), Piece(self.doc, self.start + n, self.ids[4 * n :], self.doc_tokens, self.prompt)


@dataclass
class Packer:
    """Packs pieces as they come; ``emit`` gets each finished sequence, a list of pieces."""

    emit: Callable[[list[Piece]], None]
    tokens: int = LENGTH
    segments: int = MAX_SEGMENTS
    loss: int = MAX_LOSS
    pool_size: int = POOL
    pool: list[Piece] = field(default_factory=list)

    def add(self, doc: object, ids: bytes, prompt: int = 0) -> None:
        rest = Piece(doc, 0, ids, len(ids) // 4, prompt)
        while rest.tokens:
            n = rest.fitting(self.tokens, self.loss)
            head, rest = rest.cut(n) if n < rest.tokens else (rest, Piece(doc, 0, b"", 0))
            if n == self.tokens:
                self.emit([head])
            else:
                self.pool.append(head)
            while len(self.pool) >= self.pool_size:
                self.fill()

    def fill(self) -> None:
        """Fill one sequence from the pool."""
        limits = np.array([self.tokens, self.segments, max(1, self.loss)], dtype=float)
        need = np.array([(p.tokens, 1, p.loss) for p in self.pool], dtype=float)
        room, out, gone = np.array([self.tokens, self.segments, self.loss], dtype=float), [], np.zeros(len(need), dtype=bool)
        left = None
        while room[0] >= 1 and room[1] >= 1 and not gone.all():
            product = np.where(gone, -1.0, (need / limits) @ (room / limits))
            fits = np.where((need <= room).all(axis=1), product, -1.0)
            best = int(np.argmax(fits))
            if fits[best] >= 0:
                out.append(self.pool[best])
                gone[best] = True
                room = room - need[best]
                continue
            best = int(np.argmax(product))
            head, left = self.pool[best].cut(self.pool[best].fitting(int(room[0]), int(room[2])))
            gone[best] = True
            out.append(head)
            break
        self.pool = [p for p, g in zip(self.pool, gone, strict=True) if not g]
        if left is not None:
            self.pool.append(left)
        self.emit(out)

    def close(self) -> None:
        """Place what is left; the last open sequences have lengths that are powers of two."""
        while sum(p.tokens for p in self.pool) >= self.tokens:
            self.fill()
        while self.pool:
            want = 1 << (sum(p.tokens for p in self.pool).bit_length() - 1)
            got, loss = 0, self.loss
            for p in self.pool[: self.segments]:
                n = p.fitting(want - got, loss)
                got, loss = got + n, loss - max(0, p.start + n - max(p.start + 1, p.prompt))
                if n < p.tokens:
                    break
            out, want = [], 1 << (got.bit_length() - 1)
            while want:
                piece = self.pool.pop(0)
                if piece.tokens > want:
                    piece, tail = piece.cut(want)
                    self.pool.insert(0, tail)
                out.append(piece)
                want -= piece.tokens
            self.emit(out)


def pack_documents(documents: DataFrame, tokenizer_path: str, length: int = LENGTH, segments: int = MAX_SEGMENTS, loss: int = MAX_LOSS, prompt: str | None = None) -> DataFrame:
    """A row for each piece: its document, place there, ids' checksum, sequence, place in it and loss-bearing tokens.

    ``prompt`` names a column of prompts; their ids stand before the text's and bear no loss.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, made = encoder(tokenizer_path), 0
        base = TaskContext.get().partitionId() << 36
        rows: dict[str, list] = {f.name: [] for f in PIECES}

        def emit(sequence: list[Piece]) -> None:
            nonlocal made
            at = 0
            for p in sequence:
                for name, value in (("doc_id", p.doc), ("start", p.start), ("length", p.tokens), ("ids_crc32", zlib.crc32(p.ids)), ("doc_tokens", p.doc_tokens), ("sequence_id", base + made), ("offset", at), ("loss_tokens", p.loss)):
                    rows[name].append(value)
                at += p.tokens
            made += 1

        packer, end = Packer(emit, length, segments, loss), np.array([END_ID], dtype="<u4").tobytes()
        for one in batches:
            for doc, before, text in zip(one["doc_id"], one["prompt"], one["text"], strict=True):
                asked = encode(before.as_py()) if before.is_valid else b""
                packer.add(doc.as_py(), asked + encode(text.as_py() or "") + end, len(asked) // 4)
                if len(rows["doc_id"]) >= 4096:
                    yield tx.batch(rows, PIECES)
                    for v in rows.values():
                        v.clear()
        packer.close()
        yield tx.batch(rows, PIECES)

    asked = F.lit(None) if prompt is None else F.col(prompt)
    given = documents.select(F.col("doc_id").cast("long").alias("doc_id"), asked.cast("string").alias("prompt"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(pack, tx.spark_schema(PIECES))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
