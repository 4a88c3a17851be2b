"""Queries of the ingress, vector, basis, gate and trajectory operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import edges as E
from ..operators import revisions as R
from ..operators import vectors as O
from ..operators.ranks import exact_quantiles, with_last
from . import inputs as I
from .inputs import VECTORS_SQL as W
from .registry import query

BAD = """
WITH vecs AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
bad AS (SELECT vec_id, CASE vec_id % 50 WHEN 0 THEN v[:-2] WHEN 1 THEN list_concat(v[:3], ['nan'::DOUBLE], v[5:]) WHEN 2 THEN list_concat(v[:3], ['inf'::DOUBLE], v[5:])
  WHEN 3 THEN list_transform(v, lambda x: x * 0) WHEN 4 THEN list_concat(v[:3], [NULL::DOUBLE], v[5:]) WHEN 5 THEN []::DOUBLE[] ELSE v END AS v FROM vecs),
checked AS (SELECT vec_id, CASE WHEN len(v) <> 64 OR len(v) = 0 THEN 'dimension'
  WHEN len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'numeric' WHEN list_sum(list_transform(v, lambda x: x * x)) = 0 THEN 'zero_norm' END AS reason FROM bad)
"""


def spectra(spark, d):
    return O.with_spectrum(I.unit_vectors(spark, d), I.axes(spark, d))


def variances(spark, d):
    return O.vector_variances(I.unit_vectors(spark, d), I.axes(spark, d), ["vec_id", "label"])


def gated(spark, d):
    return O.evaluate_gate(variances(spark, d), O.calibrate_threshold(I.axes(spark, d)), F.col("vec_id") % 3 != 0)


def kinetics(spark, d):
    """Steps of the trajectories with the row's variance, spectrum parts and dominant axis."""
    log = O.with_spectrum(I.vec_log(spark, d), I.axes(spark, d))
    parts = R.ortho_distance(log.withColumn("p", O.projections()), ["id", "seq", "vec_id", "vector", "p", O.dominant_axis().alias("axis_id")])
    return R.kinetics(parts.withColumn("variance", V.variance(F.col("p"))).drop("p"))


def ortho(spark, d):
    return R.ortho_distance(spectra(spark, d), ["vec_id"])


def ratios(spark, d):
    return kinetics(spark, d).where("k_cin is not null").withColumn("ratio", R.discrimination_ratio(F.col("ortho"), F.col("k_cin")))


# --- ingress ---

@query("s1_read_vectors", W + "SELECT vec_id, label, round(list_sum(v), 9) AS total, len(v)::INT AS width FROM vecs")
def _(spark, d):
    return I.raw_vectors(spark, d).select("vec_id", "label", F.round(V.total(F.col("vector")), 9).alias("total"), F.size("vector").alias("width"))


@query("i4_check_dimension", BAD + "SELECT vec_id, len(v) <> 64 AS rejected FROM bad")
def _(spark, d):
    return I.bad_vectors(spark, d).select("vec_id", (F.size("vector") != 64).alias("rejected"))


@query("i5_check_numeric", BAD + "SELECT vec_id, len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 AS rejected FROM bad")
def _(spark, d):
    return I.bad_vectors(spark, d).select("vec_id", (~V.is_finite(F.col("vector"))).alias("rejected"))


@query("i6_check_zero_norm", BAD + "SELECT vec_id FROM checked WHERE reason = 'zero_norm'")
def _(spark, d):
    checked = I.bad_vectors(spark, d).withColumn("reason", O.vector_reject_reason(F.col("vector"), 64))
    return checked.where("reason = 'zero_norm'").select("vec_id")


@query("i9_route_valid", BAD + "SELECT coalesce(reason, 'ok') AS route, count(*) AS n FROM checked GROUP BY 1")
def _(spark, d):
    checked = I.bad_vectors(spark, d).withColumn("reason", O.vector_reject_reason(F.col("vector"), 64))
    return checked.groupBy(F.coalesce("reason", F.lit("ok")).alias("route")).agg(F.count("*").alias("n"))


@query("i10_to_error_log", BAD + "SELECT 'LOG_' || vec_id AS id, '▱' AS toon_factor, 'telemetry_error' AS lifecycle_state, 0.0::DOUBLE AS action_potential, '{\"error\":\"' || reason || '\"}' AS projections, 'EPOCH_V1' AS epoch FROM checked WHERE reason IS NOT NULL")
def _(spark, d):
    dead = I.bad_vectors(spark, d).select(F.col("vec_id").alias("ingestion_id"), O.vector_reject_reason(F.col("vector"), 64).alias("reason")).where("reason is not null")
    return O.to_error_log(dead).drop("vector")


# --- projections ---

@query("v1_l2_normalize", W + "SELECT vec_id, round(u[1], 9) AS first, round(list_sum(u), 9) AS total FROM unit")
def _(spark, d):
    return I.unit_vectors(spark, d).select("vec_id", F.round(F.col("vector")[0], 9).alias("first"), F.round(V.total(F.col("vector")), 9).alias("total"))


@query("v2_zero_pad", W + "SELECT vec_id, 70::INT AS width, round(v[64], 9) AS last, 0.0::DOUBLE AS pad FROM vecs")
def _(spark, d):
    p = I.raw_vectors(spark, d).withColumn("p", V.padded(F.col("vector"), 70))
    return p.select("vec_id", F.size("p").alias("width"), F.round(F.col("p")[63], 9).alias("last"), F.col("p")[69].alias("pad"))


@query("v3_project_spectrum", W + "SELECT vec_id, axis_id, round(p, 9) AS projection FROM spec")
def _(spark, d):
    return O.project_spectrum(I.unit_vectors(spark, d), I.axes(spark, d), ["vec_id"]).select("vec_id", "axis_id", F.round("projection", 9).alias("projection"))


@query("v3_project_batches", W + "SELECT vec_id, i::INT AS axis, round(p, 9) AS projection FROM (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY axis_id) - 1 AS i, p FROM spec)")
def _(spark, d):
    wide = O.project_batches(I.unit_vectors(spark, d), I.axes(spark, d), "vec_id")
    return wide.select("vec_id", F.posexplode("projections").alias("axis", "p")).select("vec_id", "axis", F.round("p", 9).alias("projection"))


@query("v4_spectral_variance", W + "SELECT vec_id, round(variance, 9) AS variance FROM vars")
def _(spark, d):
    return variances(spark, d).select("vec_id", F.round("variance", 9).alias("variance"))


@query("v5_dominant_axis", W + "SELECT vec_id, axis_id FROM spec QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, axis_id) = 1")
def _(spark, d):
    return spectra(spark, d).select("vec_id", O.dominant_axis().alias("axis_id"))


@query("v6_node_id", W + "SELECT vec_id, 'VEC_' || label AS id FROM vecs")
def _(spark, d):
    return I.raw_vectors(spark, d).select("vec_id", F.concat(F.lit("VEC_"), F.col("label").cast("string")).alias("id"))


@query("v6_digest_id")
def _(spark, d):
    return I.unit_vectors(spark, d).select("vec_id", O.node_id(F.lit(None).cast("int"), F.col("vector")).alias("id"))


@query("v7_spectrum_json")
def _(spark, d):
    return spectra(spark, d).select("vec_id", F.to_json(O.spectrum_map()).alias("projections"))


@query("v8_ingest_vectors", W + """, fine AS (SELECT 'VEC_' || label AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS seq, vec_id, u FROM unit WHERE vec_id % 50 > 5),
 steps AS (SELECT id, seq, vec_id, u, lag(u) OVER (PARTITION BY id ORDER BY seq) AS w FROM fine),
 dead AS (SELECT 'LOG_' || vec_id AS id FROM vecs WHERE vec_id % 50 <= 5)
 SELECT id, seq, round(variance, 9) AS variance, CASE WHEN variance >= threshold AND false THEN 'consolidated' ELSE 'incubating' END AS state, axis_id,
 round(CASE WHEN w IS NOT NULL THEN 0.5 * list_sum(list_transform(list_zip(u, w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * (1 + variance) END, 6) AS k_cin
 FROM steps JOIN vars USING (vec_id) JOIN (SELECT vec_id, axis_id FROM spec QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, axis_id) = 1) USING (vec_id), theta
 UNION ALL SELECT id, 1, 0.0, 'telemetry_error', NULL, NULL FROM dead""")
def _(spark, d):
    return O.ingest_vectors(I.bad_vectors(spark, d), I.axes(spark, d), 64).select("id", "seq", F.round("variance", 9).alias("variance"), "state", "axis_id", F.round("k_cin", 6).alias("k_cin"))


@query("v10_float_drift", """SELECT l_linenumber, count(*) AS n, count(*) FILTER (drift > 1e-6) AS drifting, round(max(drift), 9) AS worst FROM
 (SELECT l_linenumber, abs(l_extendedprice::DOUBLE * (1 - l_discount::DOUBLE) - ((l_extendedprice::DOUBLE * (1 - l_discount::DOUBLE))::FLOAT)::DOUBLE) AS drift FROM lineitem) GROUP BY 1""")
def _(spark, d):
    price = F.col("l_extendedprice").cast("double") * (1 - F.col("l_discount").cast("double"))
    drift = O.float_drift(I.table(spark, d, "lineitem").select("l_linenumber", F.array(price).alias("vector")), ["l_linenumber"])
    return drift.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.sum(F.col("drifts").cast("long")).alias("drifting"), F.round(F.max("linf"), 9).alias("worst"))


@query("v11_genesis_pad", W + "SELECT vec_id, 65::INT AS width, round(variance, 9) AS variance FROM (SELECT vec_id, var_pop(p) AS variance FROM (SELECT vec_id, axis_id, p FROM spec UNION ALL SELECT vec_id, 'T9', 0.0 FROM unit) GROUP BY 1)")
def _(spark, d):
    wider = I.unit_vectors(spark, d).withColumn("vector", F.concat("vector", F.array(F.lit(0.0))))
    s = O.project_spectrum(wider, O.append_epoch(I.axes(spark, d)), ["vec_id"])
    return O.spectral_variance(s, ["vec_id"]).select("vec_id", F.lit(65).alias("width"), F.round("variance", 9).alias("variance"))


# --- basis ---

def _farthest_sql(k: int = 8) -> str:
    parts, overlap = [W, ", c0 AS (SELECT u AS a FROM unit WHERE vec_id = 0), s0 AS (SELECT vec_id, u, list_inner_product(u, a) AS o FROM unit, c0 WHERE vec_id <> 0)"], "s0"
    for i in range(1, k):
        parts.append(f", c{i} AS (SELECT vec_id, u AS a FROM {overlap} ORDER BY o, vec_id LIMIT 1), s{i} AS (SELECT s.vec_id, s.u, greatest(s.o, list_inner_product(s.u, c.a)) AS o FROM {overlap} s, c{i} c WHERE s.vec_id <> c.vec_id)")
        overlap = f"s{i}"
    picks = " UNION ALL ".join(f"SELECT {i} AS rank, vec_id FROM c{i}" for i in range(1, k))
    return "".join(parts) + f" SELECT rank::INT AS rank, vec_id FROM (SELECT 0 AS rank, 0::BIGINT AS vec_id UNION ALL {picks})"


@query("b1_select_axes", _farthest_sql())
def _(spark, d):
    chosen = O.select_axes(I.unit_vectors(spark, d), 0)
    # the k axes of the basis
    return spark.createDataFrame(list(enumerate(chosen)), "rank int, vec_id long")


@query("b2_label_axes", "SELECT 'AXIS_' || (s_suppkey + 1) AS axis_id, (9650 + s_suppkey)::BIGINT AS symbol_code, chr((9650 + s_suppkey)::INT) AS symbol, upper(replace(replace(s_name, ' ', '_'), '''', '')) AS tag FROM supplier")
def _(spark, d):
    return O.label_axes(I.table(spark, d, "supplier").select(F.col("s_suppkey").alias("rank"), F.col("s_name").alias("name"))).select("axis_id", "symbol_code", "symbol", "tag")


@query("b3_anchor_axes", W + "SELECT 'AXIS_' || (vec_id + 1) AS axis_id FROM unit WHERE vec_id >= 8")
def _(spark, d):
    new = I.unit_vectors(spark, d).select(F.concat(F.lit("AXIS_"), (F.col("vec_id") + 1).cast("string")).alias("axis_id"), F.lit("EPOCH_V1").alias("epoch"))
    return O.insert_or_ignore(new, I.axes(spark, d), ["axis_id", "epoch"]).select("axis_id")


@query("b4_active_epoch", "SELECT 'EPOCH_V' || max(label + 1) AS epoch FROM embeddings")
def _(spark, d):
    log = I.raw_vectors(spark, d).select(F.concat(F.lit("EPOCH_V"), (F.col("label") + 1).cast("string")).alias("epoch"), F.col("label").alias("created_at"))
    return O.active_epoch(log)


@query("b5_current_dimension", W + "SELECT max(len(av))::INT AS width FROM axes")
def _(spark, d):
    return I.axes(spark, d).agg(F.coalesce(F.max(F.size("vector")), F.lit(O.DEFAULT_WIDTH)).alias("width"))


@query("b6_calibrate_threshold", W + "SELECT round(threshold, 9) AS threshold FROM theta")
def _(spark, d):
    return O.calibrate_threshold(I.axes(spark, d)).select(F.round("threshold", 9).alias("threshold"))


@query("b7_basis_report", W + "SELECT round(avg(g), 9) AS mean_cosine, round(max(g), 9) AS max_cosine, count(DISTINCT a) AS axes, (SELECT round(threshold, 9) FROM theta) AS threshold FROM gram WHERE a <> b")
def _(spark, d):
    g = O.gram(I.axes(spark, d)).agg(F.round(F.avg("g"), 9).alias("mean_cosine"), F.round(F.max("g"), 9).alias("max_cosine"), F.countDistinct("a").alias("axes"))
    return g.crossJoin(F.broadcast(O.calibrate_threshold(I.axes(spark, d)).select(F.round("threshold", 9).alias("threshold"))))


@query("b8_append_epoch", W + "SELECT axis_id, 65::INT AS width, 'EPOCH_V2' AS epoch, 0.0::DOUBLE AS last FROM axes UNION ALL SELECT 'T9', 65, 'EPOCH_V2', 1.0")
def _(spark, d):
    return O.append_epoch(I.axes(spark, d)).select("axis_id", F.size("vector").alias("width"), "epoch", F.element_at("vector", -1).alias("last"))


@query("b9_epoch_invariants", "SELECT 9::BIGINT AS axes, 65::INT AS width, true AS unit_norm, 0.0::DOUBLE AS max_new_dot")
def _(spark, d):
    after = O.append_epoch(I.axes(spark, d))
    new = O.gram(after).where("a = 'T9'").agg(F.max(F.abs("g")).alias("max_new_dot"))
    return after.agg(F.count("*").alias("axes"), F.max(F.size("vector")).alias("width"), F.every(F.abs(V.norm(F.col("vector")) - 1) < 1e-9).alias("unit_norm")).crossJoin(F.broadcast(new))


# --- gate ---

@query("g1_gate_states", W + "SELECT state, count(*) AS n, round(avg(variance), 9) AS mean_variance FROM gated GROUP BY 1")
def _(spark, d):
    return gated(spark, d).groupBy("state").agg(F.count("*").alias("n"), F.round(F.avg("variance"), 9).alias("mean_variance"))


@query("g1_evaluate_gate", W + "SELECT vec_id, round(variance, 9) AS variance, passed, state FROM gated")
def _(spark, d):
    return gated(spark, d).select("vec_id", F.round("variance", 9).alias("variance"), "passed", "state")


@query("u4_gate_sql", W + "SELECT vec_id, state FROM gated")
def _(spark, d):
    maps = spectra(spark, d).crossJoin(F.broadcast(O.calibrate_threshold(I.axes(spark, d))))
    return maps.select("vec_id", V.gate_state(O.spectrum_map(), F.col("threshold"), F.col("vec_id") % 3 != 0).alias("state"))


@query("g2_consolidate", W + "SELECT id, (seq + top)::BIGINT AS seq, state, round(CASE WHEN state = 'consolidated' THEN 1.0 ELSE variance END, 9) AS potential, milestone FROM (SELECT 'VEC_' || label AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS seq, state, variance, (vec_id % 3 <> 0)::INT AS milestone FROM gated WHERE vec_id % 11 <> 0) JOIN (SELECT 'VEC_' || label AS id, count(*) AS top FROM vecs GROUP BY 1) USING (id)")
def _(spark, d):
    # every vector asks for a new revision of its label's node; some ask for a node that isn't there
    named = F.when(F.col("vec_id") % 11 == 0, "VEC_MISSING").otherwise(F.concat(F.lit("VEC_"), F.col("label").cast("string")))
    asked = I.unit_vectors(spark, d).select(named.alias("id"), "vec_id", "vector", (F.col("vec_id") % 3 != 0).alias("ethical_key"))
    found = O.consolidate(I.vec_log(spark, d), asked, I.axes(spark, d), ["vec_id"])
    return found.select("id", "seq", "state", F.round("potential", 9).alias("potential"), "milestone")


@query("g3_gate_rate", W + "SELECT coalesce(label::VARCHAR, 'all') AS category, count(*) FILTER (state = 'consolidated') AS consolidated, round(count(*) FILTER (state = 'consolidated') / count(*), 9) AS rate FROM gated GROUP BY ROLLUP (label)")
def _(spark, d):
    hit = (F.col("state") == "consolidated").cast("long")
    return gated(spark, d).rollup("label").agg(F.sum(hit).alias("consolidated"), F.round(F.avg(hit), 9).alias("rate")).select(F.coalesce(F.col("label").cast("string"), F.lit("all")).alias("category"), "consolidated", "rate")


@query("g4_gate_degenerate", W + "SELECT count(*) FILTER (state = 'consolidated') BETWEEN 1 AND count(*) - 1 AS ok FROM gated")
def _(spark, d):
    return gated(spark, d).agg(F.sum((F.col("state") == "consolidated").cast("long")).alias("c"), F.count("*").alias("n")).select(F.col("c").between(1, F.col("n") - 1).alias("ok"))


@query("g5_gate_law_violations", W + """, moved AS (SELECT vec_id, k, var_pop(m + k * (p - m)) AS v, any_value(k * k * variance) AS law FROM spec JOIN vars USING (vec_id) JOIN (SELECT vec_id, avg(p) AS m FROM spec GROUP BY 1) USING (vec_id), (VALUES (0.1::DOUBLE), (0.5), (1.0), (2.0), (5.0), (10.0)) s(k) GROUP BY ALL),
 judged AS (SELECT law >= threshold AS above, CASE WHEN v >= threshold AND true THEN 'consolidated' ELSE 'incubating' END AS with_key, CASE WHEN v >= threshold AND false THEN 'consolidated' ELSE 'incubating' END AS without FROM moved, theta)
 SELECT count(*) AS cases, count(*) FILTER (without = 'consolidated') AS no_key, count(*) FILTER (NOT above AND with_key = 'consolidated') AS below, count(*) FILTER (above AND with_key <> 'consolidated') AS above FROM judged""")
def _(spark, d):
    return O.gate_law_violations(spectra(spark, d), O.calibrate_threshold(I.axes(spark, d)))


@query("g6_variance_profile", W + "SELECT round(min(variance), 9) AS low, round(avg(variance), 9) AS mean, round(max(variance), 9) AS high, round(quantile_cont(variance, 0.5), 9) AS p50, round(quantile_cont(variance, 0.6), 9) AS p60, round(quantile_cont(variance, 0.9), 9) AS p90, round(avg(passed::INT), 9) AS share FROM gated")
def _(spark, d):
    judged = gated(spark, d)
    found = exact_quantiles(judged, "variance", [0.5, 0.6, 0.9])
    share = judged.agg(F.round(F.avg(F.col("passed").cast("int")), 9).alias("share"))
    return found.select(*[F.round(c, 9).alias(c) for c in ("low", "mean", "high")], *[F.round(F.col("quantiles")[i], 9).alias(n) for i, n in enumerate(("p50", "p60", "p90"))]).crossJoin(F.broadcast(share))


# --- trajectories ---

@query("r11_previous_vector", W + "SELECT id, seq, round(w[1], 9) AS first FROM prev")
def _(spark, d):
    return R.with_previous(I.vec_log(spark, d)).select("id", "seq", F.round(F.col("previous")[0], 9).alias("first"))


@query("k1_finite_difference", W + "SELECT id, seq, round(u[1] - w[1], 9) AS first FROM prev WHERE w IS NOT NULL")
def _(spark, d):
    return R.finite_difference(I.vec_log(spark, d)).select("id", "seq", F.round(F.col("delta")[0], 9).alias("first"))


@query("k2_kinetic_resistance", W + "SELECT id, seq, round(k_cin, 6) AS k_cin FROM kc")
def _(spark, d):
    return kinetics(spark, d).select("id", "seq", F.round("k_cin", 6).alias("k_cin"))


@query("k3_ortho_distance", W + "SELECT vec_id, round(ortho, 6) AS ortho FROM orth")
def _(spark, d):
    return ortho(spark, d).select("vec_id", F.round("ortho", 6).alias("ortho"))


@query("k4_discrimination_ratio", W + "SELECT id, seq, round(ratio, 6) AS ratio FROM ratio")
def _(spark, d):
    return ratios(spark, d).select("id", "seq", F.round("ratio", 6).alias("ratio"))


@query("k5_route_novelty", W + "SELECT CASE WHEN ratio < 1 THEN 'incubating' ELSE 'pending_approval' END AS state, CASE WHEN ratio < 1 THEN 'quarantine_noise' ELSE 'structural_candidate' END AS route, count(*) AS n FROM ratio GROUP BY ALL")
def _(spark, d):
    low = F.col("ratio") < 1.0
    return ratios(spark, d).groupBy(F.when(low, "incubating").otherwise("pending_approval").alias("state"), F.when(low, "quarantine_noise").otherwise("structural_candidate").alias("route")).agg(F.count("*").alias("n"))


@query("k6_dimensional_relief", W + "SELECT id, seq, 65::INT AS width, round(coalesce(k_cin, 0), 6) AS last FROM kc")
def _(spark, d):
    r = kinetics(spark, d).withColumn("relief", F.concat("vector", F.array(F.coalesce("k_cin", F.lit(0.0)))))
    return r.select("id", "seq", F.size("relief").alias("width"), F.round(F.element_at("relief", -1), 6).alias("last"))


@query("k7_laminarity", W + "SELECT id, round(avg(step), 6) AS laminarity FROM kc WHERE seq > 1 GROUP BY 1")
def _(spark, d):
    return kinetics(spark, d).where("step is not null").groupBy("id").agg(F.round(F.avg("step"), 6).alias("laminarity"))


@query("k8_orthogonality_loss", W + "SELECT round(var_pop(sqrt(pp)), 9) AS loss FROM orth")
def _(spark, d):
    return ortho(spark, d).agg(F.round(F.var_pop(F.sqrt("pp")), 9).alias("loss"))


@query("k9_projection_norm", W + "SELECT vec_id, round(sqrt(pp), 6) AS norm FROM orth")
def _(spark, d):
    return ortho(spark, d).select("vec_id", F.round(F.sqrt("pp"), 6).alias("norm"))


@query("k10_lab_kinetic", W + "SELECT id, seq, round(0.5 * step, 6) AS k FROM kc WHERE seq > 1")
def _(spark, d):
    return kinetics(spark, d).where("step is not null").select("id", "seq", F.round(0.5 * F.col("step"), 6).alias("k"))


REGION = "CASE WHEN vec_id < 250 THEN 'laminar' ELSE 'compressed' END"


@query("k11_pressure_verdict", W + f", r AS (SELECT {REGION} AS region, avg(k_cin) AS m FROM kc GROUP BY 1) SELECT round((SELECT m FROM r WHERE region = 'laminar'), 6) AS laminar, round((SELECT m FROM r WHERE region = 'compressed'), 6) AS compressed, (SELECT m FROM r WHERE region = 'compressed') > (SELECT m FROM r WHERE region = 'laminar') AS valid")
def _(spark, d):
    m = kinetics(spark, d).withColumn("region", F.expr(REGION)).groupBy().pivot("region", ["laminar", "compressed"]).agg(F.avg("k_cin"))
    return m.select(F.round("laminar", 6).alias("laminar"), F.round("compressed", 6).alias("compressed"), (F.col("compressed") > F.col("laminar")).alias("valid"))


@query("k12_relief_verdict", W + """SELECT round(b, 6) AS loss_before, round(a, 6) AS loss_after, round(lb, 6) AS laminarity_before, round(la, 6) AS laminarity_after, (b - a > 0.001 OR la - lb > 0.001) AS valid FROM
 (SELECT var_pop(pnorm) AS b, var_pop(sqrt(list_inner_product(u, u) + coalesce(k_cin, 0) * coalesce(k_cin, 0))) AS a, avg(step) AS lb, avg(step + (coalesce(k_cin, 0) - kp) * (coalesce(k_cin, 0) - kp)) AS la
 FROM (SELECT *, lag(coalesce(k_cin, 0)) OVER (PARTITION BY id ORDER BY seq) AS kp FROM kc JOIN unit USING (vec_id)))""")
def _(spark, d):
    full = kinetics(spark, d).withColumn("k", F.coalesce("k_cin", F.lit(0.0)))
    full = with_last(full, "k", "kp")
    after = F.sqrt(V.dot(F.col("vector"), F.col("vector")) + F.col("k") * F.col("k"))
    m = full.agg(F.var_pop(F.sqrt("pp")).alias("b"), F.var_pop(after).alias("a"), F.avg("step").alias("lb"), F.avg(F.col("step") + (F.col("k") - F.col("kp")) * (F.col("k") - F.col("kp"))).alias("la"))
    return m.select(F.round("b", 6).alias("loss_before"), F.round("a", 6).alias("loss_after"), F.round("lb", 6).alias("laminarity_before"), F.round("la", 6).alias("laminarity_after"), ((F.col("b") - F.col("a") > 0.001) | (F.col("la") - F.col("lb") > 0.001)).alias("valid"))


@query("k13_novelty_verdict", W + f", r AS (SELECT {REGION} AS region, avg(coalesce(k_cin, 0)) AS k, avg(pnorm) AS p FROM kc GROUP BY 1) SELECT round(abs(max(k) - min(k)), 6) AS k_gap, round(abs(max(p) - min(p)), 6) AS p_gap, abs(max(k) - min(k)) > 0.01 OR abs(max(p) - min(p)) > 0.01 AS supported FROM r")
def _(spark, d):
    full = kinetics(spark, d).withColumn("region", F.expr(REGION))
    r = full.groupBy("region").agg(F.avg(F.coalesce("k_cin", F.lit(0.0))).alias("k"), F.avg(F.sqrt("pp")).alias("p"))
    g = r.agg((F.max("k") - F.min("k")).alias("k"), (F.max("p") - F.min("p")).alias("p"))
    return g.select(F.round("k", 6).alias("k_gap"), F.round("p", 6).alias("p_gap"), ((F.col("k") > 0.01) | (F.col("p") > 0.01)).alias("supported"))


@query("k14_phase_profile", W + "SELECT vec_id // 100 AS phase, round(min(k_cin), 6) AS k_min, round(max(k_cin), 6) AS k_max, round(min(ratio), 6) AS r_min, round(max(ratio), 6) AS r_max, round(avg(ratio), 6) AS r_mean, max(k_cin) > 0.05 AS moving, avg(ratio) < 1 AS noisy FROM ratio GROUP BY 1")
def _(spark, d):
    # phases of equal length: a row's phase follows from its place
    return ratios(spark, d).withColumn("phase", F.floor(F.col("vec_id") / 100)).groupBy("phase").agg(F.round(F.min("k_cin"), 6).alias("k_min"), F.round(F.max("k_cin"), 6).alias("k_max"), F.round(F.min("ratio"), 6).alias("r_min"), F.round(F.max("ratio"), 6).alias("r_max"), F.round(F.avg("ratio"), 6).alias("r_mean"), (F.max("k_cin") > 0.05).alias("moving"), (F.avg("ratio") < 1).alias("noisy"))


@query("k15_trend_check", W + ", o AS (SELECT id, k_cin, row_number() OVER (PARTITION BY id ORDER BY seq) AS a, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS z FROM ratio) SELECT id, round(avg(k_cin) FILTER (a <= 10), 6) AS early, round(avg(k_cin) FILTER (z <= 10), 6) AS late, avg((k_cin > 0)::INT) >= 0.8 AND avg(k_cin) FILTER (z <= 10) >= 0.8 * avg(k_cin) FILTER (a <= 10) AS ok FROM o GROUP BY 1")
def _(spark, d):
    # k_cin is null on first revisions alone: numbers from 2 to an id's highest are its values
    k = kinetics(spark, d).select("id", "seq", "k_cin").where("k_cin is not null")
    o = k.join(k.groupBy("id").agg(F.max("seq").alias("top")), "id").withColumn("a", F.col("seq") - 1).withColumn("z", F.col("top") - F.col("seq") + 1)
    early, late = F.avg(F.when(F.col("a") <= 10, F.col("k_cin"))), F.avg(F.when(F.col("z") <= 10, F.col("k_cin")))
    return o.groupBy("id").agg(F.round(early, 6).alias("early"), F.round(late, 6).alias("late"), ((F.avg((F.col("k_cin") > 0).cast("int")) >= 0.8) & (late >= 0.8 * early)).alias("ok"))


@query("m1_category_stats", W + "SELECT label, count(*) AS n, round(avg(variance), 9) AS mean, round(stddev_pop(variance), 9) AS std, count(*) FILTER (passed) AS above, count(*) FILTER (NOT passed) AS below FROM gated GROUP BY 1")
def _(spark, d):
    return gated(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("variance"), 9).alias("mean"), F.round(F.stddev_pop("variance"), 9).alias("std"), F.sum(F.col("passed").cast("long")).alias("above"), F.sum((~F.col("passed")).cast("long")).alias("below"))


RUNS = W + """, given AS (SELECT 'full' AS provider, vec_id, label, v FROM vecs UNION ALL SELECT 'half', vec_id, label, list_concat(v[1:32], list_transform(range(32), lambda x: 0.0::DOUBLE)) FROM vecs
 UNION ALL SELECT 'coarse', vec_id, label, list_transform(v, lambda x: floor(x * 8) / 8) FROM vecs),
 run AS (SELECT provider, vec_id, label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM given),
 rvar AS (SELECT provider, vec_id, label, var_pop(list_inner_product(u, av)) AS variance FROM run, axes GROUP BY ALL),
 rgate AS (SELECT *, variance >= threshold AS passed FROM rvar, theta)
"""


def runs(spark, d):
    """The vectors as three providers give them: whole, the first half padded, and in steps of an eighth."""
    v = F.col("vector")
    made = F.array(*[F.struct(F.lit(name).alias("provider"), x.alias("vector")) for name, x in (("full", v), ("half", V.padded(F.slice(v, 1, 32), 64)), ("coarse", F.transform(v, lambda x: F.floor(x * 8) / 8)))])
    return I.raw_vectors(spark, d).select("vec_id", "label", F.explode(made).alias("m")).select("m.provider", "vec_id", "label", V.unit(F.col("m.vector")).alias("vector"))


@query("m8_sigma_by_provider", RUNS + "SELECT provider, label, round(avg(variance), 9) AS mean, round(var_pop(variance), 12) AS var FROM rvar GROUP BY ALL")
def _(spark, d):
    return O.sigma_by_provider(O.vector_variances(runs(spark, d), I.axes(spark, d), ["provider", "vec_id", "label"])).select("provider", "label", F.round("mean", 9).alias("mean"), F.round("var", 12).alias("var"))


@query("m6_coupling_report", RUNS + """, k AS (SELECT provider, coalesce(label::VARCHAR, 'all') AS category, avg(passed::INT) AS kappa, avg(variance) AS sigma, count(*) AS n FROM rgate GROUP BY GROUPING SETS ((provider), (provider, label))),
 e AS (SELECT a.provider, count(*) AS edges FROM run a JOIN run b ON a.provider = b.provider AND a.vec_id < b.vec_id WHERE sqrt(list_sum(list_transform(list_zip(a.u, b.u), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) <= 1.2 GROUP BY 1)
 SELECT provider, category, round(kappa, 6) AS kappa, round(sigma, 6) AS sigma, coalesce(edges, 0) AS edges, round(coalesce(edges, 0) / ((SELECT count(*) FROM vecs) * ((SELECT count(*) FROM vecs) - 1) / 2), 4) AS density,
 round((SELECT max(kappa) - min(kappa) FROM k WHERE category = 'all'), 6) AS coupling FROM k LEFT JOIN e USING (provider)""")
def _(spark, d):
    vecs = runs(spark, d)
    gated = O.evaluate_gate(O.vector_variances(vecs, I.axes(spark, d), ["provider", "vec_id", "label"]), O.calibrate_threshold(I.axes(spark, d)), F.lit(True))
    # pairs of one provider only, all providers in one pass
    edges = E.near_counts(vecs.select("provider", F.format_string("%019d", "vec_id").alias("id"), "vector"), [1.2], by="provider").select(F.col("key").alias("provider"), F.col("n").alias("edges"))
    found = O.coupling_report(gated, edges)
    return found.select("provider", "category", F.round("kappa", 6).alias("kappa"), F.round("sigma", 6).alias("sigma"), "edges", F.round("density", 4).alias("density"), F.round("coupling", 6).alias("coupling"))
