"""Numpy helpers that work on many texts at once, used inside Arrow batches.

Texts are handled as UTF-8 bytes.  A *block* is a run of whole texts joined by
newlines into one buffer of about a megabyte (a single longer text makes
a block of its own), so that numpy calls cost little per text and memory stays
bounded whatever the Arrow batch holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over all output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_KEYS = mix(np.arange(1, 257, dtype=U64) * _MULT)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash multiplier and of its inverse modulo 2**64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _MULT), ("down", _INVERSE)):
            run = np.full(size, base, dtype=U64)
            run[0] = 1
            _POWERS[name] = np.multiply.accumulate(run)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running polynomial hash; ``(h[j] - h[i]) * down[i]`` depends on bytes i..j-1 alone."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum(BYTE_KEYS[buf] * up[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


@dataclass
class Block:
    """Texts joined by newlines: text i is ``buf[start[i]:end[i]]``."""

    index: np.ndarray
    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of all words (runs of other than ASCII white space)."""
        inner = np.zeros(len(self.buf) + 2, dtype=np.int8)
        inner[1:-1] = ~SPACE[self.buf]
        step = np.diff(inner)
        s, e = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        return s, e, np.searchsorted(self.start, s, side="right") - 1


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES, lower: bool = False) -> Iterator[Block]:
    """Cut a column of strings or bytes (null: empty) into blocks of whole texts."""
    column = texts.cast(pa.binary()) if not pa.types.is_binary(texts.type) else texts
    held: list[bytes] = []
    first, size = 0, 0

    def made() -> Block:
        joined = b"\n".join(held)
        if lower:
            joined = joined.translate(LOWER_BYTES)
        lengths = np.fromiter(map(len, held), dtype=np.int64, count=len(held))
        start = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        return Block(np.arange(first, first + len(held)), np.frombuffer(joined, dtype=np.uint8), start, start + lengths)

    for i, scalar in enumerate(column):
        one = scalar.as_py() or b""
        if held and size + len(one) > limit:
            yield made()
            held, first, size = [], i, 0
        held.append(one)
        size += len(one) + 1
    if held:
        yield made()


def per_text(n_texts: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each text's run in an array whose items are in text order."""
    edges = np.searchsorted(of, np.arange(n_texts + 1), side="left")
    return edges[:-1], edges[1:]


def segment_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of values[start:end] for every pair, 0 for empty ones."""
    running = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return running[end] - running[start]


def batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def arrow_schema(**fields: pa.DataType) -> pa.Schema:
    return pa.schema(list(fields.items()))


def spark_schema(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean"}

    def of(t: pa.DataType) -> str:
        return f"array<{of(t.value_type)}>" if pa.types.is_list(t) else names[t]

    return ", ".join(f"{f.name} {of(f.type)}" for f in schema)


def chunks(items: Iterable, size: int) -> Iterator[list]:
    held: list = []
    for x in items:
        held.append(x)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
