"""Order MinHash fingerprints with built-in functions alone.

A text is cut into words (at most ``WORD_CHARS`` code points each), and its
k-mers are runs of ``K`` words.  Every k-mer is numbered by its occurrence in the
text.  Each two slots have a random order of their own: k-mers lie in ``BINS`` bins by
the first bits of their hash with the occurrence, and order i goes by the hash of the
bin and i, then by the hash of the k-mer and i.  One slot takes the ``PER_SLOT`` smallest k-mers in it, the
other the ``PER_SLOT`` largest, which are the smallest of the order turned round; each
puts its k-mers back in text order and hashes them as a tuple.  So an order is drawn
over bins, whatever the text's length, and over the k-mers of the outermost bins alone.  A slot agrees between
two texts only if they hold the same k-mers in the same order.  Every slot of a text
with at least ``PER_SLOT`` k-mers holds ``PER_SLOT`` of them, so order counts in short
texts too.  The likeness of two fingerprints is the share of agreeing slots; an empty
fingerprint is like another empty one (1.0) and unlike all others (0.0).

Defined results: a null text counts as empty and has the all-zero fingerprint; a
text of fewer than ``K`` words is a single k-mer; equal texts have equal
fingerprints.  Of repeated rows of one id each is a row of the order, by the hash
of its text.  Rows without an id are no part of the order: their next text is
empty.  An empty table gives no rows.  Other columns are not carried, whatever
their names.  A text's words and hashes are held by the task that reads it, some 50
bytes for each word, and a text may have up to 2**31 words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read

K = 3
WORD_CHARS = 16
SLOTS = 64
PER_SLOT = 2
#: Bins of k-mers, a power of two.
BINS = 64
#: Ranges of ids that are ordered apart; each is one key of the shuffle.
RANGES = 20_000


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def kmers(words: Column, k: int) -> Column:
    """Hashes of the runs of k words."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[words[i + j] for j in range(k)]))
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, F.array(F.xxhash64(words))).otherwise(runs)


def numbered(hashes: Column, clear: Column) -> Column:
    """Hashes of k-mer and occurrence number, in any order; the bits that are not in ``clear`` hold the k-mer's place."""
    packed = lambda g, at: g.bitwiseAND(clear).bitwiseOR(at.cast("long"))
    plain = F.transform(hashes, lambda h, i: packed(F.xxhash64(h, F.lit(0)), i))

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (s[F.greatest(i - 1, F.lit(0))]["h"] != s[i]["h"]))

        def number(firsts: Column) -> Column:
            def one(first: Column, r: Column) -> Column:
                end = F.coalesce(F.get(firsts, r + 1), n)
                return F.transform(F.slice(s, first + 1, end - first), lambda x, occurrence: packed(F.xxhash64(x["h"], occurrence), x["at"]))

            return F.flatten(F.transform(firsts, one))

        return let(starts, number)

    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), plain).otherwise(let(placed, runs))


def slot_hashes(hashes: Column, slots: int, per_slot: int) -> Column:
    """The tuple hash of each slot from the k-mers in text order.

    K-mers are longs whose low bits hold their place, so that one sort puts those of a
    bin together.  Ranks end in the bin's number or the k-mer's place in the same way,
    so that a rank says whose it is.  Bindings by ``let`` are kept out of what is done
    for each order: Spark derives their types anew each time.
    """
    n = F.size(hashes)
    mask = F.when(n < (1 << 24), F.lit((1 << 24) - 1)).otherwise(F.lit((1 << 31) - 1)).cast("long")
    bin_of = lambda x: F.shiftrightunsigned(x, 64 - (BINS - 1).bit_length())

    def of(mask: Column, clear: Column, placed: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), n - 1), lambda j: (j == 0) | (bin_of(placed[F.greatest(j - 1, F.lit(0))]) != bin_of(placed[j])))

        def with_bins(f: Column, bins: Column) -> Column:
            place = lambda rank: rank.bitwiseAND(BINS - 1).cast("int")
            size = lambda b: F.coalesce(F.get(f, b + 1), n) - f[b]

            def slot(ranks: Column, i: Column, ascending: bool) -> Column:
                own = lambda x: F.xxhash64(x.bitwiseAND(clear), i).bitwiseAND(clear).bitwiseOR(x.bitwiseAND(mask))
                inside = lambda b: F.slice(F.sort_array(F.transform(F.slice(placed, f[b] + 1, size(b)), own), ascending), 1, per_slot)
                # further bins are looked into only if the outermost has too few
                needed = F.slice(ranks, 1, F.when(size(place(ranks[0])) >= per_slot, 1).otherwise(per_slot))
                chosen = F.slice(F.flatten(F.transform(needed, lambda r: inside(place(r)))), 1, per_slot)
                return F.hash(F.transform(F.sort_array(F.transform(chosen, lambda r: r.bitwiseAND(mask).cast("int"))), lambda p: hashes[p])).bitwiseOR(1)

            def of_order(i: Column) -> Column:
                ranks = F.transform(bins, lambda b, j: F.xxhash64(b, i).bitwiseAND(~(BINS - 1)).bitwiseOR(j.cast("long")))
                return F.flatten(F.transform(F.array(F.sort_array(ranks)), lambda r: F.array(slot(r, i, True), slot(F.reverse(r), i, False))))

            return F.slice(F.flatten(F.transform(F.sequence(F.lit(0), F.lit((slots - 1) // 2)), of_order)), 1, slots)

        return let(firsts, lambda f: let(F.transform(f, lambda at: bin_of(placed[at])), lambda bins: with_bins(f, bins)))

    return let(mask, lambda m: let(F.bitwise_not(m), lambda c: let(F.sort_array(numbered(hashes, c)), lambda placed: of(m, c, placed))))


def fingerprint(text: Column, k: int = K, slots: int = SLOTS, per_slot: int = PER_SLOT) -> Column:
    """The tuple hash of each slot as an array of ints; all 0 without words."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]{1,%d}" % WORD_CHARS), F.lit(0))
    empty = F.array_repeat(F.lit(0), slots)
    return let(let(words, lambda w: kmers(w, k)), lambda h: F.when(F.size(h) == 0, empty).otherwise(slot_hashes(h, slots, per_slot)))


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing slots."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda v: v))
    return same / F.size(a)


def as_text(slots: Column) -> Column:
    return F.array_join(F.transform(slots, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0")), "")


def id_range(documents: DataFrame) -> Column:
    """The number of the range that a row's doc_id lies in; ranges hold about as many rows each.

    There are about sqrt(rows) ranges, ``RANGES`` at most.  Their bounds are
    quantiles of the ids, whatever the ids' spread, and are looked up in two steps.
    """
    count = documents.count()
    wanted = min(RANGES, math.ceil(math.sqrt(count)))
    bounds = documents.agg(F.percentile_approx("doc_id", [k / wanted for k in range(1, wanted)], max(1000, 5 * wanted))).first()[0] if wanted > 1 else None
    bounds = sorted(set(bounds or ()))
    if not bounds:
        return F.lit(0)
    step = math.ceil(math.sqrt(len(bounds)))
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    up_to = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col("doc_id")))
    own = let(up_to(longs([g[0] for g in groups])) - 1, lambda g: F.when(g < 0, 0).otherwise(g * step + up_to(F.get(F.array(*map(longs, groups)), g))))
    return own


def with_next(documents: DataFrame, made: dict[str, Column]) -> DataFrame:
    """Rows of (doc_id, text) with made columns, and all but doc_id again as ``next_<column>`` from the row that follows in descending doc_id.

    The last row is followed by the first; every id is known.  Each range of ids is
    ordered by a window of its own.  The first row of a range is also put behind the
    last row of the range above it, so no window spans the table.
    """
    rows = documents.withColumns({"part": id_range(documents), "tie": F.xxhash64("text"), "copy": F.lit(False)})
    heads = rows.groupBy("part").agg(F.max("doc_id").alias("doc_id"))
    # a row for each range: RANGES at most
    order = Window.orderBy(F.desc("part"))
    above = heads.select("doc_id", F.coalesce(F.lag("part").over(order), F.min("part").over(Window.partitionBy())).alias("above"))
    copies = rows.join(F.broadcast(above), "doc_id")
    first = copies.groupBy("above").agg(F.min("tie").alias("tie"))  # of repeated ids one row follows
    copies = copies.join(F.broadcast(first), ["above", "tie"]).dropDuplicates(["above"])
    copies = copies.select("doc_id", "text", F.col("above").alias("part"), "tie", F.lit(True).alias("copy"))
    every = rows.unionByName(copies).withColumns(made)
    ordered = Window.partitionBy("part").orderBy("copy", F.desc("doc_id"), "tie")
    led = {f"next_{c}": F.lead(c).over(ordered) for c in ("text", *made)}
    return every.withColumns(led).where(~F.col("copy")).drop("part", "tie", "copy")


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    made = {"slots": fingerprint(F.col("text"))}
    paired = with_next(rows.where(F.col("doc_id").isNotNull()), made)
    alone = rows.where(F.col("doc_id").isNull()).withColumns(made).withColumns({"next_text": F.lit(""), "next_slots": F.array_repeat(F.lit(0), SLOTS)})
    n = F.char_length("text")
    edited = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 3) as int))"), F.expr("left(next_text, cast(floor(char_length(text) / 3) as int))"))
    full = paired.unionByName(alone).select("doc_id", n.cast("long").alias("n_chars"), "slots", "next_slots", edited.alias("edited"))
    prints = full.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "slots", "next_slots", fingerprint(F.col("edited")).alias("edited_slots"))
    return prints.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("slots")).alias("fingerprint"), as_text(F.col("edited_slots")).alias("edited_fingerprint"),
        likeness(F.col("slots"), F.col("edited_slots")).alias("near_edited"), likeness(F.col("slots"), F.col("next_slots")).alias("near_next"),
    )


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
