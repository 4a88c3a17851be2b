"""Periodic runs of words by block convolution, and texts with the repeats of their runs taken out.

A run is a stretch of consecutive words with smallest period q that holds at least
``exponent`` periods and ``least`` words, and that no neighbouring word extends.

At the dyadic scale B (1, 2, 4, ...) runs with a period of B to 2 B - 1 are sought.
Such a run holds a whole *block* of words that starts at a multiple of B, and the
block's copy one period further on: in the window that follows, at a distance below 2 B.
A block's sums of squared differences from all places of its window are three
convolutions' worth of sums, made by number-theoretic transforms over the integers modulo
a prime; words stand for small integers, so that a sum below the prime is
zero only where no place differs.  The distances of zero mismatch seed extensions to both sides
over the words themselves, which give the run's ends; stretches with a smaller
period drop out by the prime divisors of the distance.

Blocks are longer than ``PATTERN`` words at no scale (a shorter block at the same
place is within the run too), and windows are cut accordingly, so transforms are of
bounded size whatever the text's length.  A block with a word that does not come back
within 2 B words has no copy and is not transformed.  Distances that a known run
explains (multiples of its period within it) are not extended again.

Defined results: a null, empty or blank text has no words and no runs, and its
collapsed text is empty; repeated rows are judged one by one; two runs that overlap
are both returned; an empty table gives no rows; rows without an id are judged as others.
Other columns are not carried, whatever their names.  Words are compared by 64-bit hashes.
A task holds one whole text and some 60 bytes for each of its bytes at a time, whatever
the text's length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .fingerprints import let
from .tables import read, small_batches

EXPONENT = 4
LEAST = 6
#: Words of a block, a power of two.
PATTERN = 1 << 12
#: Values that are transformed together.
TOGETHER = 1 << 18

#: A prime with 2**27 dividing PRIME - 1, and a primitive root of it.
PRIME, ROOT = 15 * (1 << 27) + 1, 31

FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.binary())])
FOUND_SPARK = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def reduced(x: np.ndarray) -> np.ndarray:
    """Modulo the prime; numpy divides by a constant faster than it takes remainders."""
    return x - x // PRIME * PRIME


@lru_cache
def twiddles(size: int, inverse: bool) -> list[np.ndarray]:
    """For each halving of the transform: powers of its root of unity."""
    out = []
    while size > 1:
        w = pow(ROOT, (PRIME - 1) // size, PRIME)
        w = pow(w, -1, PRIME) if inverse else w
        run = np.ones(size // 2, dtype=np.int64)
        k = 1
        while k < size // 2:  # doubled, so that no loop goes over single powers
            run[k : 2 * k] = reduced(run[:k] * pow(w, k, PRIME))
            k *= 2
        out.append(run)
        size //= 2
    return out


def transform(rows: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row, frequencies in bit-reversed order."""
    n, size = rows.shape
    for w in twiddles(size, False):
        half = len(w)
        pair = rows.reshape(n, -1, 2, half)
        u, v = pair[:, :, 0], pair[:, :, 1]
        rows = np.stack((reduced(u + v), reduced((u - v + PRIME) * w)), axis=2).reshape(n, size)
    return rows


def restored(rows: np.ndarray) -> np.ndarray:
    """The inverse of ``transform``."""
    n, size = rows.shape
    for w in reversed(twiddles(size, True)):
        half = len(w)
        pair = rows.reshape(n, -1, 2, half)
        u, v = pair[:, :, 0], reduced(pair[:, :, 1] * w)
        rows = np.stack((reduced(u + v), reduced(u - v + PRIME)), axis=2).reshape(n, size)
    return reduced(rows * pow(size, -1, PRIME))


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences of each block (b values) from the places 0 to b - 1 of its window (2 b - 1 values)."""
    n, b = blocks.shape
    size = 2 * b
    pattern, field = np.zeros((n, size), dtype=np.int64), np.zeros((n, size), dtype=np.int64)
    pattern[:, :b], field[:, : size - 1] = blocks[:, ::-1], windows
    cross = restored(reduced(transform(pattern) * transform(field)))[:, b - 1 : size - 1]
    squares = np.zeros((n, size), dtype=np.int64)
    np.cumsum(windows * windows, axis=1, out=squares[:, 1:])
    return reduced((blocks * blocks).sum(axis=1)[:, None] + squares[:, b:] - squares[:, :b] + 2 * (PRIME - cross))


def zero_distances(words: np.ndarray, starts: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Of blocks at the starts: every (start, distance) without mismatch, scale <= distance < 2 scale."""
    b = min(scale, PATTERN)
    small = words % (math.isqrt((PRIME - 1) // b) + 1)
    small = np.concatenate((small, np.zeros(2 * scale + 2 * b, dtype=np.int64)))
    found = [(np.zeros(0, dtype=np.int64),) * 2]
    many = max(1, TOGETHER // (2 * b))
    inner, outer = np.arange(b), np.arange(2 * b - 1)
    for ahead in range(scale, 2 * scale, b):
        for k in range(0, len(starts), many):
            at = starts[k : k + many]
            row, place = np.nonzero(mismatches(small[at[:, None] + inner], small[at[:, None] + (ahead + outer)]) == 0)
            found.append((at[row], ahead + place))
    s, d = (np.concatenate(x) for x in zip(*found, strict=True))
    inside = s + d + b <= len(words)
    return s[inside], d[inside]


def equal_ahead(words: np.ndarray, at: int, d: int) -> int:
    """How many words from ``at`` on equal those d further on."""
    step, done = 64, 0
    while at + done + d < len(words):
        a, z = at + done, min(at + done + step, len(words) - d)
        differ = np.flatnonzero(words[a:z] != words[a + d : z + d])
        if len(differ):
            return done + int(differ[0])
        done, step = done + z - a, 2 * step
    return done


def equal_behind(words: np.ndarray, at: int, d: int) -> int:
    """How many words before ``at`` equal those d further on."""
    step, done = 64, 0
    while done < at:
        z, a = at - done, max(0, at - done - step)
        differ = np.flatnonzero(words[a:z] != words[a + d : z + d])
        if len(differ):
            return done + z - a - 1 - int(differ[-1])
        done, step = done + z - a, 2 * step
    return done


@lru_cache(maxsize=1 << 16)
def prime_divisors(n: int) -> tuple[int, ...]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return (*out, n) if n > 1 else tuple(out)


def explained(s: np.ndarray, d: np.ndarray, b: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether a known run holds a block and its copy at a multiple of the run's period."""
    if not runs:
        return np.zeros(len(s), dtype=bool)
    start, length, period = np.array(sorted(runs)).T
    end = start + length
    far = np.maximum.accumulate(end)
    which = np.maximum.accumulate(np.where(end == far, np.arange(len(end)), 0))  # the run that reaches furthest
    k = np.searchsorted(start, s, side="right") - 1
    run = which[np.maximum(k, 0)]
    return (k >= 0) & (end[run] >= s + d + b) & (d % period[run] == 0) & (d > period[run])


def periodic_runs(words: np.ndarray, longest: int | None = None, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a row of word numbers, by start and period.

    ``longest``: no run is longer, where the row holds several texts with unique words between them.
    """
    if exponent < 4:
        raise ValueError("a run of fewer than 4 periods may hold no block together with its copy")
    n = len(words)
    longest = n if longest is None else longest
    back = np.full(n, n + longest + 1)
    order = np.argsort(words, kind="stable")
    same = words[order[1:]] == words[order[:-1]]
    back[order[:-1][same]] = np.diff(order)[same]
    runs: list[tuple[int, int, int]] = []
    scale = 1
    while exponent * scale <= longest:
        b = min(scale, PATTERN)
        held = n // scale  # a block that the end cuts has no copy
        worst = back[: held * scale].reshape(held, scale)[:, :b].max(axis=1)
        starts = np.flatnonzero(worst < 2 * scale) * scale
        if len(starts):
            s, d = zero_distances(words, starts, scale)
            new = ~explained(s, d, b, runs)
            s, d = s[new], d[new]
            order, at, until = np.lexsort((s, d)), 0, -1
            last = 0
            for at, period in zip(s[order].tolist(), d[order].tolist(), strict=True):
                if period == last and at < until:
                    continue
                ahead = equal_ahead(words, at, period)
                last, until = period, at + ahead
                if ahead < b:
                    continue
                first = at - equal_behind(words, at, period)
                length = until - first + period
                if length < max(least, exponent * period):
                    continue
                head = words[first : first + 2 * period]
                if not any(np.array_equal(head[:period], head[e : e + period]) for e in (period // p for p in prime_divisors(period))):
                    runs.append((first, length, period))
        scale *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def find_runs(documents: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs and collapsed: the words that stay, joined by a space, a row for each input row.

    A word stays unless some run holds it after its first ``period`` words.
    """
    small_batches(documents.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            for block in tx.blocks(one["text"]):
                texts = len(block.start)
                s, e, of = block.words()
                _, codes = np.unique(tx.span_hash(tx.prefix_hash(block.buf), s, e), return_inverse=True)
                first, last = tx.per_text(texts, of)
                count = last - first
                words = np.empty(len(s) + texts, dtype=np.int64)
                words[np.arange(len(s)) + of] = codes
                words[last + np.arange(texts)] = len(s) + np.arange(texts)  # between texts, each unique
                begin = first + np.arange(texts)
                own: list[list[tuple[int, int, int]]] = [[] for _ in range(texts)]
                for start, length, period in periodic_runs(words, int(count.max(initial=0)), exponent, least):
                    i = int(np.searchsorted(begin, start, side="right")) - 1
                    own[i].append((start - int(begin[i]), length, period))
                raw, kept = block.buf.tobytes(), []
                for i in range(texts):
                    parts = raw[block.start[i] : block.end[i]].split()
                    if own[i]:
                        cover = np.zeros(len(parts) + 1, dtype=np.int64)
                        for start, length, period in own[i]:
                            cover[start + period] += 1
                            cover[start + length] -= 1
                        parts = [parts[k] for k in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]
                    kept.append(b" ".join(parts))
                runs = [[{"start": a, "length": n, "period": q} for a, n, q in x] for x in own]
                ids = one["doc_id"].slice(int(block.index[0]), texts)
                yield pa.RecordBatch.from_arrays([ids, pa.array(count, pa.int64()), pa.array(runs, FOUND.field("runs").type), pa.array(kept, pa.binary())], schema=FOUND)

    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(find, FOUND_SPARK)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def looped(doc_id: Column, text: Column) -> Column:
    """The text, or for ids whose checksum ends in 0 its words with a tail that repeats."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: w[F.when(i < a, i).otherwise(a + (i - a) % p)]), " ")

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.when(h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, tail(w)).otherwise(""))).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    found = find_runs(documents.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text")))
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    length, period = -F.col("top.minus"), F.col("top.period")
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
