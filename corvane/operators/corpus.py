"""Text corpora: units, lexicon projection, compression distance, Markov chains, rank tests, encoders."""

from __future__ import annotations

import bz2
import hashlib
import lzma
import math
import zlib
from collections.abc import Callable, Iterator
from itertools import batched
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import vectors as V
from ..sources.tables import kept

#: Fixed values that results must share.
TOKEN = r"[a-z0-9]+(?:-[a-z0-9]+)*"
CODECS: dict[str, Callable[[bytes], int]] = {"zlib": lambda b: len(zlib.compress(b, 9)), "bz2": lambda b: len(bz2.compress(b, 9)), "lzma": lambda b: len(lzma.compress(b, preset=6))}


def split_manifest(docs: DataFrame, min_len: int = 20) -> DataFrame:
    """A row for each line of at least min_len characters after squeezing white space."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", "[\\u200b\\u200c\\u200d\\ufeff]", ""), r"[ \t\r\f\x0b]+", " "))
    return lines.select("doc_id", "line", text.alias("text")).where(F.length("text") >= min_len)


def validate_corpus(docs: DataFrame, minimum: dict[str, int], total: int) -> DataFrame:
    """One row for each rule: the count, its minimum, and whether it is met."""
    counts = docs.groupBy("category").agg(F.count("*").alias("n"))
    limits = docs.sparkSession.createDataFrame([(k, v) for k, v in minimum.items()], "category string, least long")
    per = limits.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"), "least")
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total").alias("category"), "n", F.lit(total).cast("long").alias("least"))
    return per.unionByName(whole).withColumn("passed", F.col("n") >= F.col("least"))


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def tokens(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(key, F.explode(tokenize(F.col("text"))).alias("token"))


#: Forms of a lexicon up to which a document's hits are counted inside its row.
ROW_FORMS = 256


def lexicon_hits(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Adds ``hits``, an array of (group, hits) in the order of the groups, counted inside each row: no shuffle.

    The lexicon (form, group, rank) has at most ``ROW_FORMS`` forms; one listed twice
    belongs to the last group.  A null text has no hits.
    """
    owner = lexicon.groupBy("form").agg(F.max_by("group", "rank").alias("group")).agg(F.map_from_entries(F.collect_list(F.struct("form", "group"))).alias("__owner"))
    groups = lexicon.agg(F.array_sort(F.collect_set("group")).alias("__groups"))
    forms = [r["form"] for r in lexicon.select("form").distinct().limit(ROW_FORMS + 1).collect()]
    if len(forms) > ROW_FORMS:
        raise ValueError(f"a lexicon of more than {ROW_FORMS} forms is joined to the tokens")
    # a set of literals is looked up by hash, a map entry by entry
    hit = F.filter(F.coalesce(tokenize(F.col("text")), F.array().cast("array<string>")), lambda t: t.isin(*forms) if forms else F.lit(False))
    found = F.transform(hit, lambda t: F.element_at("__owner", t))
    given = docs.crossJoin(F.broadcast(owner.crossJoin(groups)))  # one row of ROW_FORMS forms
    # an array of one, so that the tokens are found once for all groups
    hits = F.transform(F.array(found), lambda f: F.transform("__groups", lambda g: F.struct(g.alias("group"), F.size(F.filter(f, lambda x: x == g)).cast("long").alias("hits"))))[0]
    return given.withColumn("hits", hits).drop("__owner", "__groups")


def project_sparse(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Share of each group among a document's lexicon hits; every group appears, 0 without hits.

    The lexicon is (form, group, rank); a form listed twice belongs to the last group.
    A large lexicon is joined to the tokens instead of counted inside the rows.
    """
    if lexicon.limit(ROW_FORMS + 1).count() <= ROW_FORMS:
        counted = lexicon_hits(docs, lexicon).select("doc_id", "hits", F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["hits"]).alias("total"))
        filled = counted.select("doc_id", "total", F.inline("hits"))
    else:
        owner = lexicon.groupBy("form").agg(F.max_by("group", "rank").alias("group"))
        hits = tokens(docs).join(owner, F.col("token") == F.col("form")).groupBy("doc_id", "group").agg(F.count("*").alias("hits"))
        every = docs.select("doc_id").crossJoin(lexicon.select("group").distinct()).join(hits, ["doc_id", "group"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
        filled = every.join(every.groupBy("doc_id").agg(F.sum("hits").alias("total")), "doc_id")
    return filled.select("doc_id", "group", "hits", "total", F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(0.0).alias("share"))


def sparse_variance(shares: DataFrame) -> DataFrame:
    """Of the long form."""
    return shares.groupBy("doc_id").agg(F.sum(F.abs("share")).alias("charge"), F.var_pop("share").alias("variance"))


def sparse_scores(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Adds charge and variance of the shares to each document, inside its row; for lexicons of at most ``ROW_FORMS`` forms."""
    total = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["hits"])
    counted = lexicon_hits(docs, lexicon).withColumn("__total", total)
    shares = counted.withColumn("__shares", F.transform("hits", lambda h: F.when(F.col("__total") > 0, h["hits"] / F.col("__total")).otherwise(0.0)))
    return shares.withColumns({"charge": V.total(F.col("__shares")), "variance": V.variance(F.col("__shares"))}).drop("hits", "__total", "__shares")


def weighted_axes(lexicon: DataFrame) -> DataFrame:
    """(group, term, weight) with unit rows, kept sparse."""
    size = lexicon.groupBy("group").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("size"))
    return lexicon.join(size, "group").select("group", "term", (F.col("weight") / F.col("size")).alias("weight"))


def project_weighted(docs: DataFrame, axes: DataFrame) -> DataFrame:
    """density = sum of alpha / tokens, and the variance of alpha's shape over the groups."""
    groups = axes.select("group").distinct()
    t = tokens(docs)
    counted = t.groupBy("doc_id").agg(F.count("*").alias("tokens"))
    alpha = t.join(axes, F.col("token") == F.col("term")).groupBy("doc_id", "group").agg(F.sum("weight").alias("alpha"))
    every = docs.select("doc_id").crossJoin(F.broadcast(groups)).join(alpha, ["doc_id", "group"], "left").withColumn("alpha", F.coalesce("alpha", F.lit(0.0)))
    sums = every.groupBy("doc_id").agg(F.sum("alpha").alias("total"), F.var_pop("alpha").alias("v"))
    joined = sums.join(counted, "doc_id", "left")
    return joined.select("doc_id", F.coalesce(F.col("total") / F.col("tokens"), F.lit(0.0)).alias("density"), F.when(F.col("total") > 0, F.col("v") / (F.col("total") * F.col("total"))).otherwise(0.0).alias("variance"))


def lexicon_threshold(axes: DataFrame) -> DataFrame:
    """Mean over groups of the variance of their products with the other groups."""
    a, b = axes.select(F.col("group").alias("a"), "term", F.col("weight").alias("x")), axes.select(F.col("group").alias("b"), "term", F.col("weight").alias("y"))
    groups = axes.select("group").distinct()
    pairs = groups.select(F.col("group").alias("a")).join(F.broadcast(groups.select(F.col("group").alias("b"))), F.col("a") != F.col("b"))
    products = a.join(b, "term").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("g"))
    filled = pairs.join(products, ["a", "b"], "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
    return filled.groupBy("a").agg(F.var_pop("g").alias("v")).agg(F.avg("v").alias("threshold"))


def scrambled(lexicon: DataFrame, groups: int, seed: str) -> DataFrame:
    """The forms dealt anew to equal groups, in the order of a seeded hash; a lexicon is small."""
    forms = lexicon.select("form").distinct()
    w = Window.orderBy(F.md5(F.concat(F.lit(seed), "form")), "form")
    n = forms.agg(F.count("*").alias("n"))
    placed = forms.withColumn("rank", F.row_number().over(w) - 1).crossJoin(F.broadcast(n))
    return placed.select("form", F.floor(F.col("rank") * groups / F.col("n")).cast("string").alias("group"), F.lit(0).alias("rank"))


def frequent_lexicon(docs: DataFrame, groups: int = 5, size: int = 6) -> DataFrame:
    """Groups of the most frequent tokens longer than 3, ties by token."""
    top = tokens(docs).where(F.length("token") > 3).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(groups * size)
    w = Window.orderBy(F.desc("n"), "token")  # groups * size rows
    return top.select(F.col("token").alias("form"), F.floor((F.row_number().over(w) - 1) / size).cast("string").alias("group"), F.lit(0).alias("rank"))


def ncd(pairs: DataFrame, texts: DataFrame, codec: str = "zlib") -> DataFrame:
    """Compression distance of candidate pairs (a, b); each text's own size is computed once.

    Texts come to Python in batches of ``HELD_TEXTS`` bytes, whatever their lengths, for the session.
    """
    size = CODECS[codec]
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(HELD_TEXTS))
    alone = F.pandas_udf(lambda s: s.map(lambda t: size(t.encode())).astype("int64"), "long")
    both = F.pandas_udf(lambda x, y: pd.Series([size((p + q).encode()) for p, q in zip(x, y, strict=True)], dtype="int64"), "long")
    sized = texts.select("doc_id", "text", alone("text").alias("size"))
    x, y = (sized.select(F.col("doc_id").alias(k), F.col("text").alias(f"t{k}"), F.col("size").alias(f"c{k}")) for k in "ab")
    joined = pairs.join(x, "a").join(y, "b").withColumn("c", both("ta", "tb"))
    top = F.greatest("ca", "cb")
    return joined.select("a", "b", F.when(top == 0, 0.0).otherwise((F.col("c") - F.least("ca", "cb")) / top).alias("ncd"))


#: Bytes of a block of the reference: half of zlib's window, so that a text of that size before it is still in reach.
BLOCK = 1 << 14
#: Bytes of texts, and blocks, that one group of comparisons holds.
HELD_TEXTS, HELD_BLOCKS = 1 << 23, 64
#: Bytes of texts of a group, as far as held texts allow: some three seconds' work for three blocks, so that no core waits long for another's group.
DEALT_TEXTS = 1 << 21
#: Tasks that the groups are dealt to, two for each up to this number, so that few tasks get several.
MOST_TASKS = 1000


def reference_blocks(texts: DataFrame, order: str, block: int = BLOCK) -> DataFrame:
    """(block, reference): all texts in their order, joined by line ends and cut every ``block`` bytes; one empty block if there are none."""
    own = texts.where(F.col("text").isNotNull()).select(F.col(order).alias("o"), F.col("text").cast("binary").alias("t"))
    # kept, as the ranges may differ when they are drawn again
    ranged = own.repartitionByRange("o", "t").withColumn("part", F.spark_partition_id()).checkpoint()
    sizes = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.sum(F.length("t") + 1).alias("n")).collect()}
    spark = texts.sparkSession
    if not sizes:
        return spark.createDataFrame([(0, b"")], "block long, reference binary")
    parts = sorted(sizes)
    begin = spark.createDataFrame([(p, sum(sizes[q] for q in parts if q < p)) for p in parts], "part int, begin long")
    total = sum(sizes.values()) - 1
    w = Window.partitionBy("part").orderBy("o", "t").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("z", F.sum(F.length("t") + 1).over(w)).join(F.broadcast(begin), "part")
    z = F.col("begin") + F.col("z")
    placed = placed.select((z - F.length("t") - 1).alias("a"), F.least(z, F.lit(total)).alias("z"), F.concat("t", F.lit(b"\n")).alias("t"))
    of = F.sequence(F.floor(F.col("a") / block), F.floor((F.col("z") - 1) / block))
    cut = placed.where("z > a").select("*", F.explode(of).alias("block"))
    lo, hi = F.greatest("a", F.col("block") * block), F.least("z", (F.col("block") + 1) * block)
    pieces = cut.select("block", lo.alias("at"), F.substring("t", (lo - F.col("a") + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("at", "piece"))), F.lit(b""), lambda x, y: F.concat(x, y["piece"]))
    found = pieces.groupBy("block").agg(joined.alias("reference"))
    return found if total else spark.createDataFrame([(0, b"")], "block long, reference binary")


def zlib_sizes(text: bytes, blocks: list[bytes]) -> tuple[int, list[int]]:
    """``CODECS["zlib"]`` of a text alone and before each block, going over the text once and carrying on from there."""
    packer = zlib.compressobj(9)
    n = len(packer.compress(text))

    def then(more: bytes) -> int:
        own = packer.copy()
        return n + len(own.compress(more)) + len(own.flush())

    return then(b""), [then(b) for b in blocks]


def ncd_to_reference(docs: DataFrame, blocks: DataFrame, codec: str = "zlib") -> DataFrame:
    """1 - distance of each text to the reference: the mean over all its blocks, by their bytes.

    Equal texts are compared once. Texts and blocks are dealt to pairs of groups of bounded size; one block gives the distance to it.
    """
    size = CODECS[codec]
    keyed = docs.select("doc_id", F.col("text").cast("binary").alias("text")).withColumn("sha", F.sha2("text", 256))
    known = keyed.where(F.col("text").isNotNull())
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups, parts = -(-blocks.count() // HELD_BLOCKS), n_bytes // min(DEALT_TEXTS, HELD_TEXTS) + 1
    pair, tasks = ["part", "group"], min(2 * groups * parts, MOST_TASKS)
    x = known.select("sha", "text").distinct().withColumn("part", F.pmod(F.xxhash64("sha"), F.lit(parts)).cast("long"))
    x = x.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    y = blocks.withColumn("group", F.pmod(F.col("block"), F.lit(groups)).cast("long"))
    y = y.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def near(texts: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        references = [bytes(b) for b in some.sort_values("block")["reference"]]
        own, weights = [size(b) for b in references], [max(1, len(b)) for b in references]
        out = []
        for text in texts["text"]:
            text = bytes(text)
            c, both = zlib_sizes(text, references) if codec == "zlib" else (size(text), [size(text + b) for b in references])
            out.append(sum(w * (1 - (z - min(c, o)) / max(c, o)) for w, z, o in zip(weights, both, own, strict=True)))
        return pd.DataFrame({"sha": texts["sha"], "near": pd.Series(out, dtype="float64"), "weight": sum(weights)}, columns=["sha", "near", "weight"])

    # a number of tasks of its own, as small texts take long
    found = x.repartition(tasks, *pair).groupBy(*pair).cogroup(y.repartition(tasks, *pair).groupBy(*pair)).applyInPandas(near, "sha string, near double, weight long")
    # written, so that texts are shuffled for the join alone and many copies of one can be split
    nearness = kept(found.groupBy("sha").agg((F.sum("near") / F.sum("weight")).alias("nearness")))
    # null texts have no nearness
    missing = keyed.where(F.col("text").isNull()).select("doc_id", F.lit(None).cast("double").alias("nearness"))
    return known.select("doc_id", "sha").join(nearness, "sha").select("doc_id", "nearness").unionByName(missing)


def split_reference(docs: DataFrame, seed: str = "seed") -> DataFrame:
    """True for the first half of each category in the order of a seeded hash.

    Ranks are places in one of 4096 ranges of hashes and the sizes of the ranges
    below, so that a category is ordered in many tasks.
    """
    hashed = docs.select("doc_id", "category", F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string"))).alias("h")).withColumn("range", F.substring("h", 1, 3))
    sizes = hashed.groupBy("category", "range").agg(F.count("*").alias("n"))
    of = Window.partitionBy("category")
    # at most 4096 rows a category
    below = sizes.select("category", "range", F.coalesce(F.sum("n").over(of.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"), F.sum("n").over(of).alias("n"))
    place = F.row_number().over(Window.partitionBy("category", "range").orderBy("h", "doc_id"))
    ranked = hashed.withColumn("place", place).join(below, ["category", "range"])
    return ranked.select("doc_id", "category", (F.col("below") + F.col("place") <= F.floor(F.col("n") / 2)).alias("reference"))


#: Transitions that a task hands on at a time.
SOME = 50_000


def by_document(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, text) of lower-cased texts longer than n, those of one id side by side in one task; no more than the texts is shuffled."""
    texts = docs.where(F.length("text") > n).select("doc_id", F.lower("text").alias("text"))
    # a number of its own, as small texts may take long
    return texts.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id")


def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, list[str]]]:
    """Each id with its texts, from rows in the order of ids."""
    own, texts = None, []
    for one in batches:
        for doc_id, text in zip(one["doc_id"].to_pylist(), one["text"].to_pylist(), strict=True):
            if texts and doc_id != own:
                yield own, texts
                texts = []
            own = doc_id
            texts.append(text)
    if texts:
        yield own, texts


def transitions(texts: list[str], n: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams in order, and the places (from, to), the count and the share of each transition between successive ones of a text."""
    points = [np.frombuffer(t.encode("utf-32-le"), dtype="<u4").astype(np.int64) for t in texts]
    sizes = [max(0, len(p) - n + 1) for p in points]
    owner = np.repeat(np.arange(len(texts)), sizes)
    ids = np.concatenate([p[:k] for p, k in zip(points, sizes, strict=True)])
    for j in range(1, n):
        # ranks by one character more; code points have 21 bits
        _, ids = np.unique((ids << 21) + np.concatenate([p[j : j + k] for p, k in zip(points, sizes, strict=True)]), return_inverse=True)
    _, first, ids = np.unique(ids, return_index=True, return_inverse=True)
    begin = np.cumsum([0, *sizes])
    grams = [texts[o][k : k + n] for o, k in zip(owner[first], first - begin[owner[first]], strict=True)]
    within = owner[1:] == owner[:-1]
    steps, counts = np.unique(ids[:-1][within] * len(grams) + ids[1:][within], return_counts=True)
    a, b = np.divmod(steps, max(1, len(grams)))
    return grams, a, b, counts, counts / np.bincount(a, counts, len(grams))[a]


def bigram_transitions(docs: DataFrame, n: int = 2) -> DataFrame:
    """Row-normalised transitions between successive character n-grams of each document, counted a document at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows() -> pa.RecordBatch:
            ids = pa.array([d for d, _ in held], kind).take(pa.array(np.repeat(np.arange(len(held)), [len(f[1]) for _, f in held])))
            begin = np.cumsum([0, *[len(f[0]) for _, f in held]])
            grams = pa.array([g for _, f in held for g in f[0]], "string")
            ends = [grams.take(pa.array(np.concatenate([f[k] + at for (_, f), at in zip(held, begin[:-1], strict=True)]))) for k in (1, 2)]
            return pa.RecordBatch.from_arrays([ids, *ends, *[pa.array(np.concatenate([f[k] for _, f in held])) for k in (3, 4)]], ["doc_id", "a", "b", "n", "p"])

        for doc_id, texts in documents(batches):
            found = transitions(texts, n)
            held.append((doc_id, found))
            size += len(found[1])
            if size >= SOME:
                yield rows()
                held, size = [], 0
        if held:
            yield rows()

    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    return by_document(docs, n).mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, a string, b string, n long, p double")


def distinct_documents(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of documents with texts longer than n, the key that of the lower-cased texts of an id, in any order; and (doc_id, text) of one document for each key, with the key for its id."""
    long = docs.where(F.length("text") > n)
    shas = long.select("doc_id", F.sha2(F.lower("text"), 256).alias("sha")).groupBy("doc_id").agg(F.array_sort(F.collect_list("sha")).alias("shas"))
    # an id's digests are read by both
    keys = kept(shas.select("doc_id", F.sha2(F.concat_ws(" ", "shas"), 256).alias("key")))
    # a struct, as an id may be null
    first = keys.groupBy("key").agg(F.min(F.struct("doc_id")).alias("first")).select("key", F.col("first.doc_id").alias("own"))
    texts = long.select("doc_id", "text")
    return keys, texts.join(first, texts["doc_id"].eqNullSafe(first["own"])).select(F.col("key").alias("doc_id"), "text")


def spectral_gap(docs: DataFrame, n: int = 2) -> DataFrame:
    """Gap of the two largest eigenvalue moduli, the second, the number of states and the moduli's entropy.

    A text that is null or has no two n-grams has zeros.  A task holds the matrix of one document,
    and documents of equal texts are solved once.
    """

    def gap(texts: list[str]) -> tuple[float, float, int, float]:
        states, a, b, _, p = transitions(texts, n)
        if len(states) < 2:
            return 0.0, 0.0, len(states), 0.0
        m = np.zeros((len(states), len(states)))
        m[a, b] = p
        moduli = np.sort(np.abs(np.linalg.eigvals(m)))[::-1]
        share = moduli / moduli.sum() if moduli.sum() else moduli
        with np.errstate(divide="ignore", invalid="ignore"):
            return moduli[0] - moduli[1], moduli[1], len(states), float(-(share * np.log(share)).sum())

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batched(((doc_id, *gap(texts)) for doc_id, texts in documents(batches)), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*one, strict=True), types, strict=True)], names)

    zeros = [F.lit(0).cast(t).alias(c) for c, t in (("gap", "double"), ("second", "double"), ("states", "long"), ("entropy", "double"))]
    short = docs.where(F.col("text").isNull() | (F.length("text") <= n)).select("doc_id", *zeros)
    keys, texts = distinct_documents(docs, n)
    names = ["key", *short.columns[1:]]
    schema = T.StructType([T.StructField("key", T.StringType()), *short.schema.fields[1:]])
    types = [to_arrow_type(f.dataType) for f in schema]
    # both sides are there before the join, so that a text of many copies can be split
    solved = kept(by_document(texts, n).mapInArrow(solve, schema))
    return keys.join(solved, "key").select(short.columns).unionByName(short)


#: Ranges of values that are ranked apart.
RANGES = 128


def mann_whitney(df: DataFrame, value: str, first: Column, second: Column) -> DataFrame:
    """One row: auc, z and p from average ranks with tie correction.

    Values are counted, cut into ranges by quantiles, and ranked by offsets of the
    ranges: no window spans the table.  The quantiles are drawn once, so that a value
    lies in one range whenever a range is computed.
    """
    # written once: the bounds, the ranges' sizes and the ranks all read it
    counts = kept(df.where(first | second).groupBy(F.col(value).alias("v")).agg(F.sum(first.cast("long")).alias("n1"), F.sum(second.cast("long")).alias("n2")))
    bounds = counts.agg(F.percentile_approx("v", [k / RANGES for k in range(1, RANGES)], 50 * RANGES)).first()[0]
    kind = counts.schema["v"].dataType
    part = F.size(F.filter(F.array(*[F.lit(b).cast(kind) for b in sorted(set(bounds or ()))]).cast(T.ArrayType(kind)), lambda b: b < F.col("v")))
    cut = counts.withColumn("part", part)
    totals = cut.groupBy("part").agg(F.sum("n2").alias("s"))
    offsets = totals.withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")  # a row for each range
    below = F.coalesce(F.sum("n2").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.join(F.broadcast(offsets), "part").withColumn("below", F.col("before") + below)
    t = F.col("n1") + F.col("n2")
    s = ranked.agg(F.sum("n1").alias("a"), F.sum("n2").alias("b"), F.sum(F.col("n1") * (F.col("below") + F.col("n2") / 2)).alias("u"), F.sum((t * t * t - t).cast("double")).alias("ties"))
    n = F.col("a") + F.col("b")
    var = F.col("a") * F.col("b") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    empty = (F.coalesce("a", F.lit(0)) == 0) | (F.coalesce("b", F.lit(0)) == 0)
    scored = s.select(F.when(empty, 0.5).otherwise(F.col("u") / (F.col("a") * F.col("b"))).alias("auc"), F.when(empty | (var <= 0), 0.0).otherwise((F.col("u") - F.col("a") * F.col("b") / 2) / F.sqrt(var)).alias("z"))
    p = F.pandas_udf(lambda z: z.map(lambda x: math.erfc(abs(x) / math.sqrt(2))), "double")
    return scored.withColumn("p", p("z"))


def cohens_d(df: DataFrame, value: str, first: Column, second: Column) -> DataFrame:
    a, b = F.when(first, F.col(value)), F.when(second, F.col(value))
    s = df.agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.count(a).alias("na"), F.count(b).alias("nb"))
    pooled = F.sqrt((F.col("va") + F.col("vb")) / 2)
    return s.select(F.when((F.col("na") < 2) | (F.col("nb") < 2) | (pooled == 0), 0.0).otherwise((F.col("ma") - F.col("mb")) / pooled).alias("d"))


# --- encoders ------------------------------------------------------------

class HashProvider:
    """Deterministic vectors: standard normals seeded by the text's digest."""

    def __init__(self, dimension: int = 384, seed: int | None = None, normalise: bool = True):
        self.dimension, self.seed, self.normalise = dimension, seed, normalise

    def encode(self, text: str) -> np.ndarray:
        digest = hashlib.sha256(text.encode()).digest()
        seed = int.from_bytes(digest[:8], "little") if self.seed is None else self.seed + int.from_bytes(digest[:4], "little")
        v = np.random.default_rng(seed).standard_normal(self.dimension).astype(np.float32)
        size = np.linalg.norm(v)
        return v / size if self.normalise and size > 0 else v

    def encode_batch(self, texts: list[str]) -> np.ndarray:
        return np.stack([self.encode(t) for t in texts]) if texts else np.zeros((0, self.dimension), dtype=np.float32)


def encode(docs: DataFrame, provider, column: str = "text") -> DataFrame:
    """Adds vector array<float>; the provider has dimension, encode and encode_batch, and is made once for each worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for one in batches:
            yield pd.Series(list(provider.encode_batch(list(one))))

    return docs.withColumn("vector", run(column))
