"""Queries of the corpus, statistics, encoder and streaming operators."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import corpus as C
from ..operators import vectors as O
from ..sources import tables as sources
from ..streaming import jobs as T
from . import inputs as I
from .inputs import CORPUS_SQL as W
from .inputs import LOG_SQL
from .inputs import VECTORS_SQL
from .registry import query

#: (group, forms) of the lexicon; "que" is listed twice and belongs to the last.
LEXICON = (("EN", ("the", "of", "and", "to", "that")), ("FR", ("le", "et", "ou", "les", "que")), ("DE", ("der", "die", "und", "den")), ("ES", ("el", "que", "os")), ("MIX", ("de", "la", "en")))
FORMS_SQL = ", lexicon AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{g}', {i})" for i, (g, forms) in enumerate(LEXICON) for f in forms) + ") t(form, grp, rank)), owner AS (SELECT form, arg_max(grp, rank) AS grp FROM lexicon GROUP BY 1), groups AS (SELECT DISTINCT grp FROM lexicon)"
TOKENS_SQL = W + ", toks AS (SELECT doc_id, category, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:-[a-z0-9]+)*')) AS token FROM corpus)" + FORMS_SQL
SHARES_SQL = TOKENS_SQL + """, hits AS (SELECT doc_id, grp, count(*) AS hits FROM toks JOIN owner ON token = form GROUP BY ALL),
every AS (SELECT doc_id, category, groups.grp, coalesce(hits, 0) AS hits, sum(coalesce(hits, 0)) OVER (PARTITION BY doc_id) AS total FROM corpus CROSS JOIN groups LEFT JOIN hits USING (doc_id, grp)),
shares AS (SELECT doc_id, category, grp, hits, CASE WHEN total > 0 THEN hits / total ELSE 0.0 END AS share FROM every),
sparse AS (SELECT doc_id, category, sum(share) AS charge, var_pop(share) AS variance FROM shares GROUP BY ALL)
"""
AXES_SQL = """, used AS (SELECT form AS term, grp, 1.0::DOUBLE + count(token) AS w FROM lexicon LEFT JOIN toks ON token = form GROUP BY ALL),
weights AS (SELECT grp, term, w / sqrt(sum(w * w) OVER (PARTITION BY grp)) AS weight FROM used)
"""
WEIGHTED_SQL = TOKENS_SQL + AXES_SQL + """, counted AS (SELECT doc_id, count(*) AS tokens FROM toks GROUP BY 1), alphas AS (SELECT doc_id, grp, sum(weight) AS alpha FROM toks JOIN weights ON token = term GROUP BY ALL),
weighted AS (SELECT doc_id, sum(coalesce(alpha, 0)) AS total, var_pop(coalesce(alpha, 0)) AS v FROM corpus CROSS JOIN groups LEFT JOIN alphas USING (doc_id, grp) GROUP BY 1)
"""
RANK_SQL = """, pool AS (SELECT category, variance AS x FROM sparse), vals AS (SELECT x, count(*) FILTER (category = 'A') AS n1, count(*) FILTER (category = '{o}') AS n2 FROM pool WHERE category IN ('A', '{o}') GROUP BY 1),
cum AS (SELECT *, coalesce(sum(n2) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, (n1 + n2)::DOUBLE AS t FROM vals),
mw AS (SELECT sum(n1)::DOUBLE AS a, sum(n2)::DOUBLE AS b, sum(n1 * (below + n2 / 2))::DOUBLE AS u, sum(t * t * t - t) AS ties FROM cum)
"""


def lexicon(spark):
    rows = [(f, g, i) for i, (g, forms) in enumerate(LEXICON) for f in forms]
    return spark.createDataFrame(rows, "form string, `group` string, rank int")


def weights(spark, d):
    """Unit axes of the lexicon's groups, each form weighted by its use in the corpus."""
    used = C.tokens(I.corpus(spark, d)).groupBy("token").agg(F.count("*").alias("n"))
    forms = lexicon(spark).join(used, F.col("form") == F.col("token"), "left")
    return C.weighted_axes(forms.select("group", F.col("form").alias("term"), (F.lit(1.0) + F.coalesce("n", F.lit(0))).alias("weight")))


def shares(spark, d):
    return C.project_sparse(I.corpus(spark, d), lexicon(spark))


def sparse(spark, d):
    return C.sparse_scores(I.corpus(spark, d), lexicon(spark)).select("doc_id", "category", "charge", "variance")



def is_(c):
    return F.col("category") == c


@query("s2_read_texts", W + "SELECT doc_id, category, length(text)::INT AS n FROM corpus")
def _(spark, d):
    return I.corpus(spark, d).select("doc_id", "category", F.length("text").alias("n"))


@query("s3_iter_corpus", W + "SELECT category, count(*) AS n FROM corpus GROUP BY 1")
def _(spark, d):
    c = I.corpus(spark, d)
    parts = [c.where(is_(k)).select(F.lit(k).alias("category"), "text") for k in "ABC"]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("category").agg(F.count("*").alias("n"))


@query("s4_validate_corpus", W + ", r AS (SELECT category, count(*) AS n FROM corpus GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM corpus) SELECT category, n, CASE category WHEN 'A' THEN 40 WHEN 'B' THEN 40 WHEN 'C' THEN 20 ELSE 100 END::BIGINT AS least, n >= CASE category WHEN 'A' THEN 40 WHEN 'B' THEN 40 WHEN 'C' THEN 20 ELSE 100 END AS passed FROM r")
def _(spark, d):
    return C.validate_corpus(I.corpus(spark, d), {"A": 40, "B": 40, "C": 20}, 100)


@query("s5_split_manifest", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents), t AS (SELECT doc_id, line::INT AS line, trim(regexp_replace(raw, '[ \\t\\r\\f\\v]+', ' ', 'g')) AS text FROM l) SELECT doc_id, line, text FROM t WHERE length(text) >= 20")
def _(spark, d):
    return C.split_manifest(I.corpus(spark, d))


@query("s6_read_axes", VECTORS_SQL + "SELECT axis_id, len(av)::INT AS width, chr(9649 + replace(axis_id, 'AXIS_', '')::INT) AS symbol, 'PRIME_' || replace(axis_id, 'AXIS_', '') AS tag FROM axes")
def _(spark, d):
    place = f"{T.folder(spark)}/axes-{uuid.uuid4()}"
    axes = I.axes(spark, d)
    named = axes.select((F.regexp_extract("axis_id", r"(\d+)$", 1).cast("int") - 1).alias("rank")).withColumn("name", F.concat(F.lit("prime "), (F.col("rank") + 1).cast("string")))
    sources.write_axes(axes.join(O.label_axes(named), "axis_id"), place)
    return sources.read_axes(spark, place, "EPOCH_V1").select("axis_id", F.size("vector").alias("width"), "symbol", "tag")


@query("s7_write_report", SHARES_SQL + "SELECT category, count(*) AS n, round(avg(variance), 9) AS mean, round(count(*) FILTER (variance >= 0.05) / count(*), 9) AS above FROM sparse GROUP BY 1")
def _(spark, d):
    place = f"{T.folder(spark)}/report-{uuid.uuid4()}"
    above = (F.col("variance") >= 0.05).cast("int")
    # a row for each category
    s = sparse(spark, d).groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("variance"), 9).alias("mean"), F.round(F.avg(above), 9).alias("above"))
    report = s.agg(F.struct(F.sum("n").alias("rows"), F.lit(0.05).alias("threshold")).alias("run"), F.struct(F.collect_list(F.struct("category", "n", "mean", "above")).alias("categories")).alias("metrics"))
    return sources.write_report(report, place).select(F.explode("metrics.categories").alias("c")).select("c.*")


@query("s8_append_log", LOG_SQL + "SELECT count(*) AS n, count(DISTINCT id) AS ids FROM nlog")
def _(spark, d):
    place = f"{T.folder(spark)}/log-{uuid.uuid4()}"
    log = I.node_log(spark, d).select("id", "seq", "state")
    for part in (0, 1):
        sources.append_log(log.where(F.col("seq") % 2 == part), place)
    return spark.read.parquet(place).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query("x1_tokenize", TOKENS_SQL + "SELECT category, count(*) AS n, count(DISTINCT token) AS kinds FROM toks GROUP BY 1")
def _(spark, d):
    # a row for each token of a category: no document's tokens are joined or sorted
    kinds = C.tokens(I.corpus(spark, d), "category").groupBy("category", "token").agg(F.count("*").alias("n"))
    return kinds.groupBy("category").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))


@query("x2_project_sparse", SHARES_SQL + "SELECT doc_id, grp AS \"group\", hits, round(share, 9) AS share FROM shares")
def _(spark, d):
    return shares(spark, d).select("doc_id", "group", "hits", F.round("share", 9).alias("share"))


@query("x3_sparse_variance", SHARES_SQL + "SELECT doc_id, round(charge, 9) AS charge, round(variance, 9) AS variance FROM sparse")
def _(spark, d):
    return sparse(spark, d).select("doc_id", F.round("charge", 9).alias("charge"), F.round("variance", 9).alias("variance"))


@query("x4_weighted_axes", TOKENS_SQL + AXES_SQL + " SELECT grp AS \"group\", term, round(weight, 9) AS weight FROM weights")
def _(spark, d):
    return weights(spark, d).select("group", "term", F.round("weight", 9).alias("weight"))


@query("x5_project_weighted", WEIGHTED_SQL + "SELECT doc_id, round(coalesce(total / tokens, 0), 9) AS density, round(CASE WHEN total > 0 THEN v / (total * total) ELSE 0 END, 9) AS variance FROM weighted LEFT JOIN counted USING (doc_id)")
def _(spark, d):
    return C.project_weighted(I.corpus(spark, d), weights(spark, d)).select("doc_id", F.round("density", 9).alias("density"), F.round("variance", 9).alias("variance"))


@query("x6_lexicon_threshold", TOKENS_SQL + AXES_SQL + ", g AS (SELECT a.grp AS a, b.grp AS b, coalesce((SELECT sum(x.weight * y.weight) FROM weights x JOIN weights y USING (term) WHERE x.grp = a.grp AND y.grp = b.grp), 0) AS g FROM groups a, groups b WHERE a.grp <> b.grp) SELECT round(avg(v), 9) AS threshold FROM (SELECT a, var_pop(g) AS v FROM g GROUP BY 1)")
def _(spark, d):
    return C.lexicon_threshold(weights(spark, d)).select(F.round("threshold", 9).alias("threshold"))


@query("x7_lexicon_report", SHARES_SQL + "SELECT category, count(*) AS n, round(avg(charge), 9) AS charge, round(avg(variance), 9) AS mean, round(var_pop(variance), 9) AS spread, count(*) FILTER (charge = 0) AS empty, count(*) FILTER (variance >= 0.05 AND charge >= 0.5) AS passed FROM sparse GROUP BY 1")
def _(spark, d):
    return sparse(spark, d).groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("charge"), 9).alias("charge"), F.round(F.avg("variance"), 9).alias("mean"), F.round(F.var_pop("variance"), 9).alias("spread"), F.sum((F.col("charge") == 0).cast("long")).alias("empty"), F.sum(((F.col("variance") >= 0.05) & (F.col("charge") >= 0.5)).cast("long")).alias("passed"))


def _control_sql(forms: str) -> str:
    return TOKENS_SQL + f""", lex2 AS ({forms}), g2 AS (SELECT DISTINCT grp FROM lex2), h2 AS (SELECT doc_id, grp, count(*) AS hits FROM toks JOIN lex2 ON token = form GROUP BY ALL),
e2 AS (SELECT doc_id, category, g2.grp, coalesce(hits, 0) AS hits, sum(coalesce(hits, 0)) OVER (PARTITION BY doc_id) AS total FROM corpus CROSS JOIN g2 LEFT JOIN h2 USING (doc_id, grp)),
s2 AS (SELECT doc_id, category, var_pop(CASE WHEN total > 0 THEN hits / total ELSE 0.0 END) AS variance FROM e2 GROUP BY ALL) SELECT category, round(avg(variance), 9) AS mean FROM s2 GROUP BY 1"""


def control(spark, d, lex):
    v = C.sparse_scores(I.corpus(spark, d), lex)
    return v.groupBy("category").agg(F.round(F.avg("variance"), 9).alias("mean"))


@query("x8_scramble_control", _control_sql("SELECT form, floor((row_number() OVER (ORDER BY md5('seed' || form), form) - 1) * 5 / count(*) OVER ())::INT::VARCHAR AS grp FROM owner"))
def _(spark, d):
    return control(spark, d, C.scrambled(lexicon(spark), 5, "seed"))


@query("x9_domain_swap_control", _control_sql("SELECT token AS form, ((row_number() OVER (ORDER BY n DESC, token) - 1) // 6)::VARCHAR AS grp FROM (SELECT token, count(*) AS n FROM toks WHERE category = 'C' AND length(token) > 3 GROUP BY 1 ORDER BY n DESC, token LIMIT 30)"))
def _(spark, d):
    return control(spark, d, C.frequent_lexicon(I.corpus(spark, d).where(is_("C"))))


@query("x10_adversarial_control", "WITH corpus AS (SELECT item_id AS doc_id, 'A' AS category, text FROM benchmark)" + SHARES_SQL.split("FROM documents)", 1)[1].lstrip() + "SELECT doc_id, round(variance, 9) AS variance, variance >= 0.05 AND charge >= 0.5 AS passed FROM sparse")
def _(spark, d):
    texts = I.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    v = C.sparse_variance(C.project_sparse(texts, lexicon(spark)))
    return v.select("doc_id", F.round("variance", 9).alias("variance"), ((F.col("variance") >= 0.05) & (F.col("charge") >= 0.5)).alias("passed"))


@query("x11_ncd")
def _(spark, d):
    docs = I.corpus(spark, d)
    pairs = docs.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b")).join(docs.select(F.col("doc_id").alias("b")), "b", "left_semi")
    return C.ncd(pairs, docs)


@query("x12_ncd_to_reference")
def _(spark, d):
    # sums come in no fixed order
    near = C.ncd_to_reference(I.corpus(spark, d), C.reference_blocks(I.table(spark, d, "benchmark"), "item_id"))
    return near.select("doc_id", F.round("nearness", 9).alias("nearness"))


@query("x13_split_reference", W + "SELECT doc_id, category, row_number() OVER (PARTITION BY category ORDER BY md5('seed' || doc_id), doc_id) <= floor(count(*) OVER (PARTITION BY category) / 2) AS reference FROM corpus")
def _(spark, d):
    return C.split_reference(I.corpus(spark, d))


@query("x14_bigram_transitions", "WITH g AS (SELECT doc_id, lower(text) AS t, unnest(range(1, length(text) - 1)) AS i FROM documents WHERE length(text) > 2), s AS (SELECT doc_id, substr(t, i, 2) AS a, substr(t, i + 1, 2) AS b FROM g), c AS (SELECT doc_id, a, b, count(*) AS n FROM s GROUP BY doc_id, a, b), r AS (SELECT doc_id, a, sum(n) AS total FROM c GROUP BY doc_id, a) SELECT doc_id, count(*) AS edges, sum(n)::BIGINT AS steps, round(max(n / total), 9) AS top FROM c JOIN r USING (doc_id, a) GROUP BY doc_id")
def _(spark, d):
    t = C.bigram_transitions(I.corpus(spark, d))
    return t.groupBy("doc_id").agg(F.count("*").alias("edges"), F.sum("n").alias("steps"), F.round(F.max("p"), 9).alias("top"))


@query("x15_spectral_gap")
def _(spark, d):
    return C.spectral_gap(I.corpus(spark, d))


def _mw_sql(other: str) -> str:
    return SHARES_SQL + RANK_SQL.format(o=other) + f"SELECT 'A-{other}' AS pair, round(u / (a * b), 6) AS auc, round((u - a * b / 2) / sqrt(a * b / 12 * ((a + b + 1) - ties / ((a + b) * (a + b - 1)))), 6) AS z FROM mw"


def compared(spark, d, other):
    rows = sparse(spark, d).withColumn("variance", F.round("variance", 12))
    return C.mann_whitney(rows, "variance", is_("A"), is_(other)).select(F.lit(f"A-{other}").alias("pair"), F.round("auc", 6).alias("auc"), F.round("z", 6).alias("z"))


@query("x16_mann_whitney", _mw_sql("B").replace("variance AS x", "round(variance, 12) AS x"))
def _(spark, d):
    return compared(spark, d, "B")


@query("x17_cohens_d", SHARES_SQL + "SELECT round((avg(variance) FILTER (category = 'A') - avg(variance) FILTER (category = 'B')) / sqrt((var_samp(variance) FILTER (category = 'A') + var_samp(variance) FILTER (category = 'B')) / 2), 6) AS d FROM sparse")
def _(spark, d):
    return C.cohens_d(sparse(spark, d), "variance", is_("A"), is_("B")).select(F.round("d", 6).alias("d"))


@query("x18_compare_categories", SHARES_SQL + "SELECT 'A-' || o AS pair, round((SELECT avg(CASE WHEN x.v > y.v THEN 1.0 WHEN x.v = y.v THEN 0.5 ELSE 0.0 END) FROM (SELECT round(variance, 12) AS v FROM sparse WHERE category = 'A') x, (SELECT round(variance, 12) AS v FROM sparse WHERE category = o) y), 6) AS auc FROM (VALUES ('B'), ('C')) t(o)")
def _(spark, d):
    return compared(spark, d, "B").unionByName(compared(spark, d, "C")).select("pair", "auc")


@query("x19_length_confound", SHARES_SQL + "SELECT round(corr(variance, length(text)), 6) AS r FROM sparse JOIN documents USING (doc_id)")
def _(spark, d):
    return sparse(spark, d).join(I.corpus(spark, d).select("doc_id", F.length("text").alias("n")), "doc_id").agg(F.round(F.corr("variance", "n"), 6).alias("r"))


@query("m2_bimodality")
def _(spark, d):
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    values = sparse(spark, d)
    n, var = values.agg(F.count("*"), F.var_pop("variance")).first()
    one = -0.5 * n * (math.log(2 * math.pi * max(var, 1e-300)) + 1)
    two = GaussianMixture(k=2, seed=1).fit(VectorAssembler(inputCols=["variance"], outputCol="features").transform(values)).summary.logLikelihood
    return spark.createDataFrame([(k, float(-2 * like + (3 * k - 1) * math.log(n))) for k, like in ((1, one), (2, two))], "components int, bic double")


@query("m4_measurement_rows", SHARES_SQL + "SELECT s.doc_id, category, substr(text, 1, 80) AS text, round(variance, 9) AS variance, CASE WHEN variance >= 0.05 AND s.doc_id % 3 <> 0 THEN 'consolidated' ELSE 'incubating' END AS state, round(value, 6) AS latency, variance >= 0.05 AS above FROM sparse s JOIN documents USING (doc_id) LEFT JOIN events ON event_id = s.doc_id")
def _(spark, d):
    limit = spark.range(1).select(F.lit(0.05).alias("threshold"))
    gated = O.evaluate_gate(sparse(spark, d), limit, F.col("doc_id") % 3 != 0)
    times = I.table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("value").alias("latency"))
    joined = gated.join(I.corpus(spark, d).select("doc_id", "text"), "doc_id").join(times, "doc_id", "left")
    return joined.select("doc_id", "category", F.substring("text", 1, 80).alias("text"), F.round("variance", 9).alias("variance"), "state", F.round("latency", 6).alias("latency"), F.col("passed").alias("above"))


# --- encoders ---

def encoded(spark, d, provider=None):
    docs = C.encode(I.corpus(spark, d), provider or C.HashProvider(64))
    return docs.withColumn("vector", V.unit(V.as_double(F.col("vector"))))


@query("u1_encode")
def _(spark, d):
    return encoded(spark, d).select("doc_id", F.size("vector").alias("width"), F.round(F.col("vector")[0], 6).alias("first"))


@query("u2_hash_provider")
def _(spark, d):
    return encoded(spark, d, C.HashProvider(384)).select("doc_id", F.size("vector").alias("width"), F.round(V.norm(F.col("vector")), 6).alias("norm"))


@query("u3_seeded_provider")
def _(spark, d):
    return C.encode(I.corpus(spark, d), C.HashProvider(128, seed=7, normalise=False)).select("doc_id", F.size("vector").alias("width"), F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


@query("i7_check_encoder_output", VECTORS_SQL + "SELECT vec_id, vec_id % 50 NOT IN (0, 1, 2, 3, 4, 5) AS ok FROM vecs")
def _(spark, d):
    # what an encoder may give: of wrong width, not finite, or zero
    return I.bad_vectors(spark, d).select("vec_id", O.vector_reject_code(F.col("vector"), 64).isNull().alias("ok"))


@query("v9_ingest_texts")
def _(spark, d):
    # some texts get vectors that are too long, or none, as an encoder may fail
    docs = encoded(spark, d, C.HashProvider(48)).withColumn("vector", F.when(F.col("doc_id") % 50 == 0, V.padded(F.col("vector"), 65)).when(F.col("doc_id") % 50 != 1, F.col("vector")))
    return O.ingest_texts(docs, I.axes(spark, d), 64).withColumn("potential", F.round("potential", 9))


@query("b10_name_basis")
def _(spark, d):
    names = I.table(spark, d, "supplier").select(F.col("s_suppkey").alias("rank"), F.col("s_name").alias("name"))
    v = C.encode(names, C.HashProvider(64, normalise=False), "name").withColumn("vector", V.unit(V.as_double(F.col("vector"))))
    return O.label_axes(names).join(v.select(F.concat(F.lit("AXIS_"), (F.col("rank") + 1).cast("string")).alias("axis_id"), F.size("vector").alias("width"), F.round(V.norm(F.col("vector")), 9).alias("norm"), "vector"), "axis_id")


@query("g7_paragraph_gate")
def _(spark, d):
    units = C.split_manifest(I.corpus(spark, d)).withColumn("unit_id", F.concat_ws("-", "doc_id", "line"))
    v = C.encode(units, C.HashProvider(64)).withColumn("vector", V.unit(V.as_double(F.col("vector"))))
    gated = O.evaluate_gate(O.vector_variances(v, I.axes(spark, d), ["doc_id", "unit_id"]), O.calibrate_threshold(I.axes(spark, d)), F.lit(True))
    c = F.sum((F.col("state") == "consolidated").cast("long"))
    return gated.groupBy("doc_id").agg(F.count("*").alias("n"), c.alias("consolidated"), (c / F.count("*")).alias("rate"), c.between(1, F.count("*") - 1).alias("ok"))


# --- streams ---

@query("t1_stream_ingest", VECTORS_SQL + "SELECT vec_id, CASE WHEN vec_id % 50 IN (0, 1, 2, 3, 4, 5) THEN 'telemetry_error' ELSE state END AS state FROM gated")
def _(spark, d):
    return T.ingest_vectors(spark, d)


@query("t2_stream_dedupe", LOG_SQL + "SELECT ingestion_id, min(ingestion_id) OVER (PARTITION BY idempotency_key) AS first_id, ingestion_id > min(ingestion_id) OVER (PARTITION BY idempotency_key) AS duplicate FROM queue")
def _(spark, d):
    return T.dedupe(spark, d)


@query("t3_stream_kinetics", VECTORS_SQL + "SELECT id, seq, round(k_cin, 6) AS k_cin FROM kc")
def _(spark, d):
    return T.kinetics(spark, d)


@query("t4_stream_current", LOG_SQL + "SELECT id, seq, state FROM last")
def _(spark, d):
    return T.current(spark, d)
