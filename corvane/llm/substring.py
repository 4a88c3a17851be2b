"""Substring dedup by hashing sentences of lines and grouping their digests globally.

A text's lines are cut after sentence marks; a sentence of fewer than ``SHORT``
words belongs to the unit before it in its line, so that where a unit begins and
ends depends on its own words alone, wherever it stands.  A unit's normal form is
its words with A-Z lower-cased; its 128-bit digest is made once and grouped over the
whole table.  The earliest occurrence, by document and place, stays.  Later ones
are repeated units, and stretches of neighbouring repeated units (over line ends
too) that hold ``MIN_WORDS`` words or more are removed, with the white space that
follows them.  Shorter repeats, such as a common greeting or a heading in
otherwise new text, stay.  The removed places in the original text are returned.

Defined results: null texts stay null and have no units; texts without words stay;
an empty table gives an empty one; words are what ASCII white space parts.  Rows of
one id and one text are one document and lose the same units; rows of one id with
different texts are documents of their own, ordered by a hash of the text.  Rows
without an id are returned as they are and take nothing from others.  Other columns
pass through, unless they have the name of an added one.  A task holds one whole
text and some 60 bytes for each of its words at a time, whatever the text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .tables import keep_table, read, small_batches

#: Repeated stretches of fewer words stay.
MIN_WORDS = 15
#: Sentences of fewer words are no units of their own.
SHORT = 5

UNITS = tx.arrow_schema(of_doc=pa.int64(), tie=pa.int64(), unit=pa.int32(), start=pa.int64(), end=pa.int64(), words=pa.int32(), digest_a=pa.int64(), digest_b=pa.int64())
ADDED = [T.StructField("n_removed", T.LongType()), T.StructField("removed_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])))]

END_MARK = np.zeros(256, dtype=bool)
END_MARK[[ord(c) for c in ".!?"]] = True
_SECOND = tx.U64(0xD6E8FEB86659FD93)


def run_bounds(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the runs that begin at the flagged places; the first place is flagged."""
    first = np.flatnonzero(flags)
    return first, np.append(first[1:], len(flags))


def cut(block: tx.Block) -> dict[str, np.ndarray]:
    """The units of a lower-cased block's texts: text number, place among its units, characters, words and digests."""
    s, e, of = block.words()
    if not len(s):
        none = np.zeros(0, dtype=np.int64)
        return dict.fromkeys(("of", "unit", "start", "end", "words", "digest_a", "digest_b"), none)
    line_ends = np.concatenate(([0], np.cumsum(block.buf == 10)))
    line = np.append(True, line_ends[s[1:]] > line_ends[e[:-1]])  # texts are joined by line ends
    sentence = line | np.append(True, END_MARK[block.buf[e[:-1] - 1]])
    first, end = run_bounds(sentence)
    unit = line.copy()
    unit[first[end - first >= SHORT]] = True
    first, end = run_bounds(unit)
    text = of[first]
    hashes = tx.span_hash(tx.prefix_hash(block.buf), s, e)
    up, down = tx.powers(len(hashes) + 1)
    digests = []
    for word in (hashes, tx.mix(hashes ^ _SECOND)):
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(word * up[: len(word)], dtype=np.uint64)))
        digests.append(tx.mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64) * _SECOND).view(np.int64))
    chars = np.concatenate(([0], np.cumsum((block.buf & 0xC0) != 0x80)))
    origin, close = chars[block.start[text]], chars[block.end[text]]
    start = chars[s[first]]
    last = np.append(text[1:] != text[:-1], True)
    stop = np.where(last, close, np.append(start[1:], 0))
    number = np.arange(len(text)) - np.searchsorted(text, text)
    return {"of": text, "unit": number, "start": start - origin, "end": stop - origin, "words": end - first, "digest_a": digests[0], "digest_b": digests[1]}


def hashed_units(documents: DataFrame) -> DataFrame:
    """Every unit of (of_doc, tie, text) rows with its place and digest."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            docs, ties = one["of_doc"].to_numpy(), one["tie"].to_numpy()
            for block in tx.blocks(one["text"], lower=True):
                units = cut(block)
                row = block.index[units.pop("of")]
                yield tx.batch(units | {"of_doc": docs[row], "tie": ties[row]}, UNITS)

    return documents.mapInArrow(split, tx.spark_schema(UNITS))


def stretches(found: list[dict], min_words: int) -> list[tuple[int, int]]:
    """Start and end of the runs of neighbouring units that hold enough words."""
    out: list[list[int]] = []
    last = -2
    for u in sorted(found, key=lambda u: u["unit"]):
        if u["unit"] == last + 1:
            out[-1][1], out[-1][2] = u["end"], out[-1][2] + u["words"]
        else:
            out.append([u["start"], u["end"], u["words"]])
        last = u["unit"]
    return [(a, z) for a, z, words in out if words >= min_words]


def drop_repeated_units(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with repeated stretches cut from their text, the removed places and their number."""
    small_batches(documents.sparkSession)
    own = documents.drop(*[f.name for f in ADDED])
    keys = {"of_doc": F.col("doc_id").cast("long"), "tie": F.xxhash64("text")}
    known = own.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    units = keep_table(hashed_units(known.select(keys["of_doc"].alias("of_doc"), keys["tie"].alias("tie"), F.col("text").cast("binary").alias("text"))))
    digest = ["digest_a", "digest_b"]
    place = F.struct("of_doc", "tie", "unit")
    # written, so that both sides of the join are shuffled and its hot digests can be split
    first = keep_table(units.groupBy(digest).agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1").drop("times"))
    again = units.join(first, digest).where(place != F.col("first"))
    # at most a document's own units
    gone = again.groupBy("of_doc", "tie").agg(F.collect_set(F.struct("unit", "start", "end", "words")).alias("found"))
    fields = {c: f"__{c}" for c in ("of_doc", "tie", "found")}
    named = gone.select(*[F.col(a).alias(b) for a, b in fields.items()])
    joined = own.join(named, (keys["of_doc"] == F.col("__of_doc")) & (keys["tie"] == F.col("__tie")), "left").drop("__of_doc", "__tie")
    names = own.columns
    arrow = pa.schema([pa.field("n_removed", pa.int64()), pa.field("removed_spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            texts, places = [], []
            for text, found in zip(one["text"], one["__found"], strict=True):
                spans = stretches(found.as_py(), min_words) if found.is_valid else []
                whole = text.as_py()
                if spans:
                    starts, ends = [0, *[z for _, z in spans]], [*[a for a, _ in spans], len(whole)]
                    whole = "".join([whole[a:z] for a, z in zip(starts, ends, strict=True)])
                texts.append(whole)
                places.append([{"start": a, "length": z - a} for a, z in spans])
            columns = [pa.array(texts, one["text"].type) if n == "text" else one[n] for n in names]
            added = [pa.array([len(p) for p in places], pa.int64()), pa.array(places, arrow.field("removed_spans").type)]
            yield pa.RecordBatch.from_arrays([*columns, *added], names=[*names, *arrow.names])

    return joined.mapInArrow(remove, T.StructType([*own.schema.fields, *ADDED]))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_units(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_removed", "removed_spans", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.char_length("text").cast("long").alias("kept_chars"), "text")
