"""Checks, projections, gate and consolidation of vectors (ingress, V, B and G groups)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .edges import density
from .revisions import assign_seq, kinetics, latest

#: Fixed values of the format.
DEFAULT_EPOCH = "EPOCH_V1"
DEFAULT_WIDTH = 384
SYMBOL_BASE = 0x25B2


# --- ingress -------------------------------------------------------------

def content_type_ok(content_type: Column, allowed: tuple[str, ...] = ("text/plain",)) -> Column:
    return F.coalesce(F.trim(F.split(content_type, ";")[0]).isin(*allowed), F.lit(False))


def text_reject_code(content_type: Column, payload: Column) -> Column:
    """415 for another type, 400 for NUL bytes or invalid UTF-8, else null."""
    raw = payload.cast("binary")
    return F.when(~content_type_ok(content_type), 415).when(F.contains(raw, F.lit(b"\0")), 400).when(~F.is_valid_utf8(raw.cast("string")), 400)


def check_dimension(v: Column, width: int, mode: str = "vector") -> tuple[Column, Column]:
    """The vector to go on with, and whether it is rejected.

    In mode ``vector`` any other width is rejected; in mode ``text`` shorter vectors,
    as an encoder may give them, are padded and only longer or missing ones rejected.
    """
    if mode == "text":
        return V.padded(v, width), F.coalesce(F.size(v) > width, F.lit(True)) | v.isNull()
    return v, v.isNull() | (F.size(v) != width) | (F.size(v) == 0)


def vector_reject_code(v: Column, width: int) -> Column:
    """422 for a wrong or empty width, non-finite or missing elements, or a zero norm, in that order; else null."""
    return F.when(v.isNull() | (F.size(v) != width) | (F.size(v) == 0), 422).when(~V.is_finite(v), 422).when(V.norm(v) == 0, 422)


def vector_reject_reason(v: Column, width: int) -> Column:
    return F.when(v.isNull() | (F.size(v) != width) | (F.size(v) == 0), "dimension").when(~V.is_finite(v), "numeric").when(V.norm(v) == 0, "zero_norm")


def dedupe_idempotent(queue: DataFrame) -> DataFrame:
    """First id per key; later rows are duplicates.  Null keys never collide."""
    first = queue.where("idempotency_key is not null").groupBy("idempotency_key").agg(F.min("ingestion_id").alias("first_id"))
    joined = queue.join(first, "idempotency_key", "left")
    return joined.withColumn("first_id", F.coalesce("first_id", "ingestion_id")).withColumn("duplicate", F.col("ingestion_id") > F.col("first_id"))


def to_error_log(dead: DataFrame) -> DataFrame:
    """A telemetry_error row for each dead letter."""
    return dead.select(
        F.concat(F.lit("LOG_"), F.col("ingestion_id").cast("string")).alias("id"), F.lit("▱").alias("toon_factor"), F.lit("telemetry_error").alias("lifecycle_state"),
        F.lit(0.0).alias("action_potential"), F.array().cast("array<double>").alias("vector"), F.to_json(F.struct(F.col("reason").alias("error"))).alias("projections"), F.lit(DEFAULT_EPOCH).alias("epoch"),
    )


# --- projections ---------------------------------------------------------

def with_spectrum(vecs: DataFrame, axes: DataFrame) -> DataFrame:
    """Adds ``basis`` (the axes in order) and ``spectrum`` (their dot products with the vector), row by row; the axes are few."""
    basis = axes.agg(F.array_sort(F.collect_list(F.struct("axis_id", "vector"))).alias("basis"))
    spectrum = F.transform("basis", lambda a: F.struct(a["axis_id"].alias("axis_id"), V.dot(F.col("vector"), a["vector"]).alias("projection")))
    return vecs.crossJoin(F.broadcast(basis)).withColumn("spectrum", spectrum)


def projections() -> Column:
    """The numbers of a spectrum in axis order."""
    return F.transform("spectrum", lambda s: s["projection"])


def project_spectrum(vecs: DataFrame, axes: DataFrame, keys: list[str]) -> DataFrame:
    """Long form: a row for each vector and axis with their dot product."""
    return with_spectrum(vecs, axes).select(*keys, F.inline("spectrum"))


def project_batches(vecs: DataFrame, axes: DataFrame, key: str) -> DataFrame:
    """The same by one matrix product for each Arrow batch: key and the projections in axis order."""
    rows = axes.orderBy("axis_id").collect()  # a basis is a handful of rows
    basis = np.array([r["vector"] for r in rows], dtype=float)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for one in batches:
            p = np.stack(one["vector"].to_numpy()) @ basis.T if len(one) else np.zeros((0, len(basis)))
            yield pd.DataFrame({key: one[key], "projections": list(p)})

    kind = dict(vecs.dtypes)[key]
    return vecs.select(key, "vector").mapInPandas(multiply, f"{key} {kind}, projections array<double>")


def spectral_variance(spectrum: DataFrame, keys: list[str]) -> DataFrame:
    """Of the long form."""
    return spectrum.groupBy(*keys).agg(F.var_pop("projection").alias("variance"))


def vector_variances(vecs: DataFrame, axes: DataFrame, keys: list[str]) -> DataFrame:
    """Variance of each vector's spectrum, without a shuffle."""
    return with_spectrum(vecs, axes).select(*keys, projections().alias("p")).select(*keys, V.variance(F.col("p")).alias("variance"))


def dominant_axis() -> Column:
    """Of a spectrum: the axis of the largest signed projection; ties go to the first axis id."""
    return F.array_sort(F.transform("spectrum", lambda s: F.struct((-s["projection"]).alias("low"), s["axis_id"].alias("axis_id"))))[0]["axis_id"]


def spectrum_map() -> Column:
    """Map form of a spectrum, in axis order."""
    return F.map_from_entries("spectrum")


def digest_id(vector: pd.Series) -> pd.Series:
    return vector.map(lambda v: "VEC_" + hashlib.sha256(np.asarray(v, dtype="<f8").tobytes()).hexdigest()[:12])


def node_id(label: Column, vector: Column) -> Column:
    """VEC_<label>, or a digest of the vector's bytes where there is no label."""
    return F.when(label.isNotNull(), F.concat(F.lit("VEC_"), label.cast("string"))).otherwise(F.pandas_udf(digest_id, "string")(vector))


def float_drift(vecs: DataFrame, keys: list[str], limit: float = 1e-6) -> DataFrame:
    """Differences between each vector and its float32 round trip."""
    low = vecs.withColumn("low", F.transform("vector", lambda x: x.cast("float").cast("double")))
    gap = V.difference(F.col("vector"), F.col("low"))
    both = (V.norm(F.col("vector")) > 0) & (V.norm(F.col("low")) > 0)
    return low.select(*keys, F.array_max(F.transform(gap, lambda x: F.abs(x))).alias("linf"), V.norm(gap).alias("l2"), F.when(both, V.cosine(F.col("vector"), F.col("low"))).otherwise(1.0).alias("cosine")).withColumn("drifts", F.col("linf") > limit)


# --- basis ---------------------------------------------------------------

def select_axes(vecs: DataFrame, anchor: int, k: int = 8) -> list[int]:
    """Greedy farthest point by the smallest maximum cosine to the chosen; ties go to the lowest id.

    Each of the k - 1 passes reads the vectors once and sends only the newest axis.
    """
    chosen = [anchor]
    axes = [vecs.where(F.col("vec_id") == anchor).select("vector").first()["vector"]]
    while len(chosen) < k:
        overlap = reduce(F.greatest, [V.cosine(F.col("vector"), F.array(*[F.lit(x) for x in a])) for a in axes]) if len(axes) > 1 else V.cosine(F.col("vector"), F.array(*[F.lit(x) for x in axes[0]]))
        best = vecs.where(~F.col("vec_id").isin(chosen)).select("vec_id", "vector", overlap.alias("overlap")).orderBy("overlap", "vec_id").first()
        if best is None:
            break
        chosen.append(best["vec_id"])
        axes.append(best["vector"])
    return chosen


def label_axes(ranked: DataFrame) -> DataFrame:
    """Rank r becomes AXIS_{r+1} with its symbol and a cleaned tag.

    The symbol is the character of the code; it is null where Unicode has none
    (surrogates, and beyond 0x10FFFF), the code stays.
    """
    code = (F.col("rank") + SYMBOL_BASE).cast("long")
    known = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return ranked.select(
        F.concat(F.lit("AXIS_"), (F.col("rank") + 1).cast("string")).alias("axis_id"), code.alias("symbol_code"),
        F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).alias("symbol"),
        F.upper(F.replace(F.replace(F.col("name"), F.lit(" "), F.lit("_")), F.lit("'"), F.lit(""))).alias("tag"),
    )


def insert_or_ignore(new: DataFrame, existing: DataFrame, keys: list[str], arrival: str | None = None) -> DataFrame:
    """The rows of ``new`` whose key is not there yet, one for each key: the first by ``arrival``, or any where that isn't given.

    Rows with a missing part of the key are never the same and all stay.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    fresh = new.join(existing.select(*keys), keys, "left_anti").select(*new.columns)
    keyed = fresh.where(whole)
    if arrival is None:
        keyed = keyed.dropDuplicates(keys)
    else:
        rest = [c for c in new.columns if c not in keys]
        keyed = keyed.groupBy(*keys).agg(F.min_by(F.struct(*rest), arrival).alias("row")).select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest]).select(*new.columns)
    return keyed.unionByName(fresh.where(~whole))


def active_epoch(axes: DataFrame) -> DataFrame:
    """The epoch created last; the higher number wins a tie; the default when there is none."""
    found = axes.groupBy("epoch").agg(F.max("created_at").alias("created_at")).withColumn("number", F.regexp_extract("epoch", r"_V(\d+)$", 1).cast("int")).orderBy(F.desc("created_at"), F.desc("number")).limit(1)
    return found.agg(F.coalesce(F.max("epoch"), F.lit(DEFAULT_EPOCH)).alias("epoch"))


def gram(axes: DataFrame) -> DataFrame:
    """Dot products of all ordered pairs of different axes."""
    a, b = axes.select(F.col("axis_id").alias("a"), F.col("vector").alias("va")), axes.select(F.col("axis_id").alias("b"), F.col("vector").alias("vb"))
    return a.join(F.broadcast(b), F.col("a") != F.col("b")).select("a", "b", V.dot(F.col("va"), F.col("vb")).alias("g"))


def calibrate_threshold(axes: DataFrame) -> DataFrame:
    """One row: the mean over axes of the variance of each axis's products with the others."""
    return gram(axes).groupBy("a").agg(F.var_pop("g").alias("v")).agg(F.avg("v").alias("threshold"))


def append_epoch(axes: DataFrame, symbol: str = "✦") -> DataFrame:
    """The next epoch: each axis with one more 0.0, and the new unit axis."""
    last = axes.agg(F.max(F.regexp_extract("epoch", r"_V(\d+)$", 1).cast("int")).alias("n"), F.max(F.size("vector")).alias("d"), F.count("*").alias("k"))
    name = F.concat(F.lit("EPOCH_V"), (F.col("n") + 1).cast("string"))
    old = axes.crossJoin(F.broadcast(last)).select("axis_id", F.concat("vector", F.array(F.lit(0.0))).alias("vector"), name.alias("epoch"))
    new = last.select(F.concat(F.lit("T"), (F.col("k") + 1).cast("string")).alias("axis_id"), F.concat(F.array_repeat(F.lit(0.0), F.col("d")), F.array(F.lit(1.0))).alias("vector"), name.alias("epoch"))
    return old.unionByName(new)


# --- gate ----------------------------------------------------------------

def evaluate_gate(variances: DataFrame, threshold: DataFrame, ethical_key: Column) -> DataFrame:
    """Adds threshold, passed and state; the threshold is one row."""
    v = F.coalesce(F.col("variance"), F.lit(0.0))
    joined = variances.crossJoin(F.broadcast(threshold)).withColumn("passed", v >= F.col("threshold"))
    return joined.withColumn("state", F.when(F.col("passed") & ethical_key, "consolidated").otherwise("incubating"))


def consolidate(log: DataFrame, requests: DataFrame, axes: DataFrame, arrival: list[str]) -> DataFrame:
    """New revisions for requests (id, vector of the given text, ethical_key) whose node is in the log; others are left out.

    The potential is 1.0 for consolidated nodes, else the variance; the milestone is the key.
    """
    known = requests.join(log.select("id").distinct(), "id", "left_semi")
    variance = vector_variances(known, axes, [c for c in known.columns if c != "vector"])
    gated = evaluate_gate(variance, calibrate_threshold(axes), F.col("ethical_key"))
    rows = gated.withColumn("potential", F.when(F.col("state") == "consolidated", 1.0).otherwise(F.col("variance"))).withColumn("milestone", F.col("ethical_key").cast("int"))
    return assign_seq(rows, log, arrival)


def ingest_vectors(vecs: DataFrame, axes: DataFrame, width: int, log: DataFrame | None = None) -> DataFrame:
    """The whole path of (vec_id, label, vector) rows: checks, spectrum, gate without a key, next number, kinetics; and a dead letter for each rejected row.

    With a log (id, seq, vector), numbers and previous vectors go on from it.
    """
    checked = vecs.withColumn("reason", vector_reject_reason(F.col("vector"), width))
    good = checked.where("reason is null").select(node_id(F.col("label"), F.col("vector")).alias("id"), "vec_id", V.unit(F.col("vector")).alias("vector"))
    if log is None:
        log = good.select("id", F.lit(0).cast("long").alias("seq"), "vector").limit(0)
    numbered = with_spectrum(assign_seq(good, log, ["vec_id"]), axes).select("id", "seq", "vec_id", "vector", projections().alias("p"), dominant_axis().alias("axis_id"))
    own = numbered.withColumn("variance", V.variance(F.col("p"))).drop("p")
    before = latest(log.select("id", "seq", "vector")).select("id", "seq", F.lit(None).cast("long").alias("vec_id"), "vector", F.lit(None).cast("string").alias("axis_id"), F.lit(None).cast("double").alias("variance"))
    moved = kinetics(own.unionByName(before)).where("vec_id is not null")
    gated = evaluate_gate(moved, calibrate_threshold(axes), F.lit(False))
    dead = to_error_log(checked.where("reason is not null").withColumnRenamed("vec_id", "ingestion_id"))
    errors = dead.select("id", F.lit(1).cast("long").alias("seq"), F.lit(0.0).alias("variance"), F.col("lifecycle_state").alias("state"), F.lit(None).cast("string").alias("axis_id"), F.lit(None).cast("double").alias("k_cin"))
    return gated.select("id", "seq", "variance", "state", "axis_id", "k_cin").unionByName(errors)


def ingest_texts(encoded: DataFrame, axes: DataFrame, width: int, log: DataFrame | None = None) -> DataFrame:
    """The whole path of encoded texts (doc_id, vector): padding, spectrum, next number, always waiting for approval at milestone 0; and an error row for each text whose vector is missing or too long.

    With a log (id, seq), numbers go on from it.  Rows of one id are numbered by the digest of their vectors.
    """
    padded, rejected = check_dimension(F.col("vector"), width, "text")
    checked = encoded.select("doc_id", "vector", rejected.alias("rejected"))
    good = checked.where(~F.col("rejected")).select(F.concat(F.lit("NODE_"), F.col("doc_id").cast("string")).alias("id"), "doc_id", F.xxhash64("vector").alias("tie"), V.unit(padded).alias("vector"))
    if log is None:
        log = good.select("id", F.lit(0).cast("long").alias("seq")).limit(0)
    nodes = vector_variances(assign_seq(good, log, ["doc_id", "tie"]), axes, ["id", "seq"])
    nodes = nodes.select("id", F.col("seq").cast("long").alias("seq"), F.lit("pending_approval").alias("state"), F.col("variance").alias("potential"), F.lit(0).alias("milestone"))
    wide = F.coalesce(F.concat(F.lit("dimension "), F.size("vector").cast("string"), F.lit(f" beyond {width}")), F.lit("no vector"))
    dead = to_error_log(checked.where("rejected").select(F.col("doc_id").alias("ingestion_id"), wide.alias("reason")))
    # the id of an error is its text's own; its rows are numbered like a node's
    errors = assign_seq(dead.select("id", F.xxhash64("projections").alias("tie"), F.col("lifecycle_state").alias("state"), F.col("action_potential").alias("potential")), log, ["tie"])
    return nodes.unionByName(errors.select("id", F.col("seq").cast("long").alias("seq"), "state", "potential", F.lit(0).alias("milestone")))


def gate_law_violations(spectra: DataFrame, threshold: DataFrame, scales=(0.1, 0.5, 1.0, 2.0, 5.0, 10.0)) -> DataFrame:
    """Breaches of the gate's three laws with each spectrum's deviations scaled around its mean.

    The gate judges the scaled spectra; that they are above the threshold follows
    from the unscaled variance.
    """
    own = spectra.select("spectrum", projections().alias("p")).select("spectrum", V.mean(F.col("p")).alias("centre"), V.variance(F.col("p")).alias("variance"))
    scaled = own.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales]))).crossJoin(F.broadcast(threshold))
    moved = F.map_from_entries(F.transform("spectrum", lambda s: F.struct(s["axis_id"], F.col("centre") + F.col("scale") * (s["projection"] - F.col("centre")))))
    judged = scaled.withColumn("moved", moved).select(
        (F.col("scale") * F.col("scale") * F.col("variance") >= F.col("threshold")).alias("above"),
        *[V.gate_state(F.col("moved"), F.col("threshold"), F.lit(key)).alias(name) for key, name in ((True, "with_key"), (False, "without"))],
    )
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return judged.agg(F.count("*").alias("cases"), count(F.col("without") == "consolidated").alias("no_key"), count(~F.col("above") & (F.col("with_key") == "consolidated")).alias("below"), count(F.col("above") & (F.col("with_key") != "consolidated")).alias("above"))


def sigma_by_provider(variances: DataFrame) -> DataFrame:
    """Mean and variance of the spectral variance for each provider and label."""
    return variances.groupBy("provider", "label").agg(F.avg("variance").alias("mean"), F.var_pop("variance").alias("var"))


def coupling_report(gated: DataFrame, edges: DataFrame) -> DataFrame:
    """Share that passes and mean variance for each provider, over all (category ``all``) and for each label; its edges and their density; and the spread of the shares over all.

    ``edges`` has their number for each provider that has any.
    """
    grouped = gated.groupingSets([["provider"], ["provider", "label"]], "provider", "label").agg(F.avg(F.col("passed").cast("int")).alias("kappa"), F.avg("variance").alias("sigma"), F.count("*").alias("n"), F.grouping("label").alias("whole"))
    named = grouped.withColumn("category", F.when(F.col("whole") == 1, "all").otherwise(F.col("label").cast("string")))
    # a row for each provider
    whole = named.where("whole = 1").select("provider", "n", "kappa")
    spread = whole.agg((F.max("kappa") - F.min("kappa")).alias("coupling"))
    per = whole.join(edges.select("provider", "edges"), "provider", "left").select("provider", F.coalesce("edges", F.lit(0)).alias("edges"), density(F.coalesce("edges", F.lit(0)), F.col("n")).alias("density"))
    return named.join(F.broadcast(per), "provider").crossJoin(F.broadcast(spread)).select("provider", "category", "kappa", "sigma", "edges", "density", "coupling")
