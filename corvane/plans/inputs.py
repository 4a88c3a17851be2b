"""Views that the queries derive from the driver's tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.ranks import number_rows
from ..sources import tables as sources

N_AXES = 8


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def raw_vectors(spark: SparkSession, d: str) -> DataFrame:
    return sources.read_vectors(spark, f"{d}/embeddings.parquet")


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    return raw_vectors(spark, d).withColumn("vector", V.unit(F.col("vector")))


def axes(spark: SparkSession, d: str) -> DataFrame:
    """The basis: the first vectors, normalised."""
    return unit_vectors(spark, d).where(F.col("vec_id") < N_AXES).select(F.concat(F.lit("AXIS_"), (F.col("vec_id") + 1).cast("string")).alias("axis_id"), "vector", F.lit("EPOCH_V1").alias("epoch"))


def vec_log(spark: SparkSession, d: str) -> DataFrame:
    """Trajectories: the vectors of each label in the order of their ids."""
    numbered = number_rows(unit_vectors(spark, d), ["label"], ["vec_id"], "seq")
    return numbered.select(F.concat(F.lit("VEC_"), F.col("label").cast("string")).alias("id"), "seq", "vec_id", "vector")


def points(spark: SparkSession, d: str) -> DataFrame:
    """One node for each vector; ids have six digits, or more where the number has."""
    return unit_vectors(spark, d).select(F.format_string("NODE_%06d", "vec_id").alias("id"), "vec_id", "vector")


def node_log(spark: SparkSession, d: str) -> DataFrame:
    """Revisions of a node for each user, from their events."""
    state = F.when(F.col("event_type") == "signup", "pending_approval").when(F.col("event_type").isin("view", "click"), "incubating").when(F.col("event_type") == "purchase", "consolidated").otherwise("telemetry_error")
    numbered = number_rows(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "seq")
    return numbered.select(F.concat(F.lit("NODE_"), F.col("user_id").cast("string")).alias("id"), "seq", state.alias("state"), "ts", "event_id", "value")


def queue(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"), "event_type")
    return table(spark, d, "events").select(F.col("event_id").alias("ingestion_id"), key.alias("idempotency_key"), F.col("props").alias("payload"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return sources.read_texts(spark, f"{d}/documents.parquet", {"en": "A", "fr": "B"}, "C")


def bad_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of which six in fifty are broken, each in its own way."""
    v, kind = F.col("vector"), F.col("vec_id") % 50
    slot = lambda value: F.transform(v, lambda x, i: F.when(i == 3, value).otherwise(x))
    broken = (
        F.when(kind == 0, F.slice(v, 1, F.size(v) - 1)).when(kind == 1, slot(F.lit(float("nan")))).when(kind == 2, slot(F.lit(float("inf"))))
        .when(kind == 3, F.transform(v, lambda x: x * 0)).when(kind == 4, slot(F.lit(None).cast("double"))).when(kind == 5, F.array().cast("array<double>")).otherwise(v)
    )
    return raw_vectors(spark, d).select("vec_id", "label", broken.alias("vector"))


VECTORS_SQL = """
WITH vecs AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
unit AS (SELECT vec_id, label, CASE WHEN list_inner_product(v, v) = 0 THEN v ELSE list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) END AS u FROM vecs),
axes AS (SELECT 'AXIS_' || (vec_id + 1) AS axis_id, u AS av FROM unit WHERE vec_id < 8),
spec AS (SELECT vec_id, label, axis_id, list_inner_product(u, av) AS p FROM unit, axes),
vars AS (SELECT vec_id, label, var_pop(p) AS variance FROM spec GROUP BY ALL),
gram AS (SELECT a.axis_id AS a, b.axis_id AS b, list_inner_product(a.av, b.av) AS g FROM axes a, axes b),
theta AS (SELECT avg(v) AS threshold FROM (SELECT a, var_pop(g) AS v FROM gram WHERE a <> b GROUP BY a)),
gated AS (SELECT vec_id, label, variance, threshold, variance >= threshold AS passed, CASE WHEN variance >= threshold AND vec_id % 3 <> 0 THEN 'consolidated' ELSE 'incubating' END AS state FROM vars, theta),
vlog AS (SELECT 'VEC_' || label AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS seq, vec_id, u FROM unit),
prev AS (SELECT id, seq, vec_id, u, lag(u) OVER (PARTITION BY id ORDER BY seq) AS w FROM vlog),
orth AS (SELECT vec_id, list_inner_product(u, u) - 2 * pp + pgp AS ortho, pp FROM unit JOIN (SELECT vec_id, sum(p * p) AS pp FROM spec GROUP BY 1) USING (vec_id)
  JOIN (SELECT s.vec_id, sum(s.p * g * t.p) AS pgp FROM spec s JOIN gram ON s.axis_id = a JOIN spec t ON t.vec_id = s.vec_id AND t.axis_id = b GROUP BY 1) USING (vec_id)),
kin AS (SELECT id, seq, prev.vec_id, list_sum(list_transform(list_zip(u, w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS step, variance, sqrt(pp) AS pnorm, ortho
  FROM prev JOIN vars USING (vec_id) JOIN orth USING (vec_id)),
kc AS (SELECT *, CASE WHEN seq > 1 THEN 0.5 * step * (1 + variance) END AS k_cin FROM kin),
ratio AS (SELECT *, CASE WHEN k_cin < 1e-12 THEN ortho / 1e-12 ELSE ortho / k_cin END AS ratio FROM kc WHERE k_cin IS NOT NULL)
"""

LOG_SQL = """
WITH nlog AS (SELECT 'NODE_' || user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  CASE WHEN event_type = 'signup' THEN 'pending_approval' WHEN event_type IN ('view', 'click') THEN 'incubating' WHEN event_type = 'purchase' THEN 'consolidated' ELSE 'telemetry_error' END AS state, ts, event_id, value FROM events),
last AS (SELECT * FROM nlog QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
queue AS (SELECT event_id AS ingestion_id, user_id || strftime(ts, '%Y-%m-%d') || event_type AS idempotency_key, props AS payload FROM events)
"""

CORPUS_SQL = """
WITH corpus AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'A' WHEN 'fr' THEN 'B' ELSE 'C' END AS category, text FROM documents)
"""
