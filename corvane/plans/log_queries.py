"""Queries of the revision log, the queue, and proposal screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import revisions as R
from ..operators import screening as S
from ..operators import vectors as O
from ..operators.ranks import exact_quantiles
from . import inputs as I
from .inputs import LOG_SQL as W
from .inputs import VECTORS_SQL
from .registry import query


@query("r1_assign_seq", W + "SELECT 'NODE_' || user_id AS id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) + coalesce((SELECT max(seq) FROM nlog n WHERE n.id = 'NODE_' || e.user_id AND event_id % 2 = 0), 0) AS seq FROM events e WHERE FALSE UNION ALL SELECT id, event_id, (n + coalesce(top, 0))::BIGINT FROM (SELECT 'NODE_' || user_id AS id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'error') LEFT JOIN (SELECT id, max(seq) AS top FROM nlog WHERE state <> 'telemetry_error' GROUP BY 1) USING (id)")
def _(spark, d):
    new = I.table(spark, d, "events").where("event_type = 'error'").select(F.concat(F.lit("NODE_"), F.col("user_id").cast("string")).alias("id"), "event_id")
    return R.assign_seq(new, I.node_log(spark, d).where("state <> 'telemetry_error'"), ["event_id"])


@query("r2_current_nodes", W + "SELECT id, seq, state FROM last WHERE state <> 'telemetry_error'")
def _(spark, d):
    return R.current_nodes(I.node_log(spark, d).select("id", "seq", "state"))


@query("r3_current_vectors", "SELECT 'VEC_' || label AS id, count(*) AS seq, round(arg_max(embedding[1]::DOUBLE, vec_id), 6) AS first FROM embeddings GROUP BY label")
def _(spark, d):
    log = I.raw_vectors(spark, d).join(I.vec_log(spark, d).select("id", "seq", "vec_id"), "vec_id")
    return R.latest(log.select("id", "seq", "vector")).select("id", "seq", F.round(F.col("vector")[0], 6).alias("first"))


@query("r4_telemetry_errors", W + "SELECT id, seq, event_id FROM last WHERE state = 'telemetry_error'")
def _(spark, d):
    return R.telemetry_errors(I.node_log(spark, d)).orderBy(F.desc("ts")).select("id", "seq", "event_id")


@query("r5_node_exists", W + "SELECT user_id + 50 AS user_id, 'NODE_' || (user_id + 50) IN (SELECT id FROM nlog) AS there FROM (SELECT DISTINCT user_id FROM events)")
def _(spark, d):
    asked = I.table(spark, d, "events").select((F.col("user_id") + 50).alias("user_id")).distinct().withColumn("id", F.concat(F.lit("NODE_"), F.col("user_id").cast("string")))
    known = I.node_log(spark, d).select("id", F.lit(True).alias("hit")).distinct()
    return asked.join(known, "id", "left").select("user_id", F.coalesce("hit", F.lit(False)).alias("there"))


@query("r6_log_integrity", W + ", x AS (SELECT id, CASE WHEN event_id % 100 = 0 THEN seq + 1 ELSE seq END AS seq FROM nlog) SELECT (SELECT count(*) FROM (SELECT id, seq FROM x GROUP BY ALL HAVING count(*) > 1)) AS repeated, (SELECT count(*) FROM (SELECT id FROM x GROUP BY 1 HAVING min(seq) <> 1 OR max(seq) <> count(*) OR count(DISTINCT seq) <> count(*))) AS broken")
def _(spark, d):
    return R.log_integrity(I.node_log(spark, d).withColumn("seq", F.when(F.col("event_id") % 100 == 0, F.col("seq") + 1).otherwise(F.col("seq"))))


@query("r7_state_validity", "SELECT event_type AS state, count(*) AS n FROM events WHERE event_type NOT IN ('pending_approval', 'consolidated', 'incubating', 'telemetry_error') GROUP BY 1")
def _(spark, d):
    return I.table(spark, d, "events").select(F.col("event_type").alias("state")).where(~F.col("state").isin(*R.STATES)).groupBy("state").agg(F.count("*").alias("n"))


@query("r8_append_only_diff", W + "SELECT count(*) AS lost FROM (SELECT id, seq, state FROM nlog EXCEPT ALL SELECT id, seq, state FROM nlog WHERE event_id % 500 <> 0)")
def _(spark, d):
    log = I.node_log(spark, d)
    rest = log.where("event_id % 500 <> 0").select("id", "seq", "state")
    return R.lost_rows(log.select("id", "seq", "state"), rest).agg(F.count("*").alias("lost"))


@query("r9_lifecycle_distribution", W + "SELECT state, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM nlog GROUP BY 1")
def _(spark, d):
    counts = I.node_log(spark, d).groupBy("state").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("state", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))


@query("r10_queue_status", W + "SELECT CASE WHEN 'NODE_' || ingestion_id IN (SELECT id FROM nlog) THEN 'PROCESSED' ELSE 'PENDING' END AS status, count(*) AS n FROM queue GROUP BY 1")
def _(spark, d):
    return R.queue_status(I.queue(spark, d), I.node_log(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query("r12_count_nodes_like", W + "SELECT count(*) FILTER (id LIKE 'NODE\\_1%' ESCAPE '\\') AS nodes, count(*) FILTER (state = 'telemetry_error') AS errors FROM nlog")
def _(spark, d):
    return I.node_log(spark, d).agg(F.sum(F.col("id").like("NODE\\_1%").cast("long")).alias("nodes"), F.sum((F.col("state") == "telemetry_error").cast("long")).alias("errors"))


@query("s9_upgrade_log", "SELECT event_id AS id, 1::BIGINT AS seq, 'EPOCH_V1' AS epoch FROM events")
def _(spark, d):
    old = I.table(spark, d, "events").select(F.col("event_id").alias("id"))
    return R.upgrade_log(old).select("id", "seq", "epoch")


@query("i1_check_content_type", "SELECT event_id, event_type IN ('view') AS ok FROM events")
def _(spark, d):
    typed = F.when(F.col("event_type") == "view", " text/plain ; charset=utf-8").when(F.col("event_type") == "click", "text/html").when(F.col("event_type") == "error", F.lit(None)).otherwise("application/json")
    return I.table(spark, d, "events").select("event_id", O.content_type_ok(typed).alias("ok"))


@query("i2_check_null_bytes", "SELECT doc_id, doc_id % 7 = 0 OR contains(text, chr(0)) AS rejected FROM documents")
def _(spark, d):
    payload = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\0"))).otherwise(F.col("text"))
    return I.table(spark, d, "documents").select("doc_id", (O.text_reject_code(F.lit("text/plain"), payload).isNotNull()).alias("rejected"))


@query("i3_check_utf8", "SELECT doc_id, doc_id % 5 IN (1, 2, 3) AS rejected FROM documents")
def _(spark, d):
    raw = F.col("text").cast("binary")
    tail = F.when(F.col("doc_id") % 5 == 1, F.lit(b"\xc3")).when(F.col("doc_id") % 5 == 2, F.lit(b"\xc0\xaf")).when(F.col("doc_id") % 5 == 3, F.lit(b"\xff\xfe")).otherwise(F.lit(b""))
    return I.table(spark, d, "documents").select("doc_id", O.text_reject_code(F.lit("text/plain"), F.concat(raw, tail)).isNotNull().alias("rejected"))


@query("i8_dedupe_idempotent", W + "SELECT ingestion_id, min(ingestion_id) OVER (PARTITION BY idempotency_key) AS first_id, ingestion_id > min(ingestion_id) OVER (PARTITION BY idempotency_key) AS duplicate FROM queue")
def _(spark, d):
    return O.dedupe_idempotent(I.queue(spark, d)).select("ingestion_id", "first_id", "duplicate")


@query("m3_latency_profile", "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS high FROM events GROUP BY 1")
def _(spark, d):
    found = exact_quantiles(I.table(spark, d, "events"), "value", [0.5, 0.95, 0.99], "event_type")
    return found.select(F.col("key").alias("event_type"), F.round("mean", 6).alias("mean"), *[F.round(F.col("quantiles")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))], F.round("high", 6).alias("high"))


@query("m5_log_growth", VECTORS_SQL + ", sized AS (SELECT seq, strlen(id) + strlen('vector ' || vec_id) + 8 * len(u) AS size FROM vlog) SELECT sum(CASE WHEN seq % 2 = 1 THEN size ELSE 0 END)::BIGINT AS before, sum(size)::BIGINT AS after, (sum(size) - sum(CASE WHEN seq % 2 = 1 THEN size ELSE 0 END))::BIGINT AS growth, round(avg(size) FILTER (seq % 2 = 0), 6) AS mean_insert FROM sized")
def _(spark, d):
    log = I.vec_log(spark, d).withColumn("payload", F.concat(F.lit("vector "), F.col("vec_id").cast("string")))
    return R.log_growth(log, F.col("seq") % 2 == 1).withColumn("mean_insert", F.round("mean_insert", 6))


@query("m7_governance_checks", W + """, runs AS (SELECT 'contiguous_seq' AS rule, count(*) = 0 AS passed FROM (SELECT id FROM nlog GROUP BY 1 HAVING min(seq) <> 1 OR max(seq) <> count(*) OR count(DISTINCT seq) <> count(*))
 UNION ALL SELECT 'no_repeats', count(*) = 0 FROM (SELECT id, seq FROM nlog GROUP BY ALL HAVING count(*) > 1)
 UNION ALL SELECT 'append_only', count(*) = 0 FROM (SELECT id, seq, state FROM nlog WHERE seq <= 3 EXCEPT ALL SELECT id, seq, state FROM nlog)
 UNION ALL SELECT 'allowed_states', bool_and(state IN ('pending_approval', 'consolidated', 'incubating', 'telemetry_error')) FROM nlog
 UNION ALL SELECT 'errors_hidden', count(*) = 0 FROM (SELECT state FROM last WHERE state <> 'telemetry_error') WHERE state = 'telemetry_error'
 UNION ALL SELECT 'ingress_codes', bool_and((event_type = 'error') = (CASE WHEN event_type = 'error' THEN 415 END IS NOT NULL)) FROM events
 UNION ALL SELECT 'rejects_are_logged', (SELECT count(*) FROM events WHERE event_type = 'error') = (SELECT count(*) FROM nlog WHERE state = 'telemetry_error')) SELECT * FROM runs""")
def _(spark, d):
    log = I.node_log(spark, d)
    states = log.select("id", "seq", "state")
    integrity = R.log_integrity(log)
    typed = F.when(F.col("event_type") == "error", "text/html").otherwise("text/plain")
    coded = I.table(spark, d, "events").select(F.col("event_id").alias("ingestion_id"), (F.col("event_type") == "error").alias("wrong"), O.text_reject_code(typed, F.col("props")).alias("code"))
    dead = O.to_error_log(coded.where("code is not null").withColumn("reason", F.col("code").cast("string"))).agg(F.count("*").alias("dead"))
    hidden = states.where("state = 'telemetry_error'").agg(F.count("*").alias("logged"))
    lost = states.where("seq <= 3").exceptAll(states).agg((F.count("*") == 0).alias("passed"))
    rows = {
        "contiguous_seq": integrity.select((F.col("broken") == 0).alias("passed")), "no_repeats": integrity.select((F.col("repeated") == 0).alias("passed")), "append_only": lost,
        "allowed_states": log.agg(F.every(F.col("state").isin(*R.STATES)).alias("passed")), "errors_hidden": R.current_nodes(states).agg(F.every(F.col("state") != "telemetry_error").alias("passed")),
        "ingress_codes": coded.agg(F.every(F.col("wrong") == F.col("code").isNotNull()).alias("passed")), "rejects_are_logged": dead.crossJoin(F.broadcast(hidden)).select((F.col("dead") == F.col("logged")).alias("passed")),
    }
    out = None
    for rule, passed in rows.items():
        one = passed.select(F.lit(rule).alias("rule"), "passed")
        out = one if out is None else out.unionByName(one)
    return out


# --- proposals -----------------------------------------------------------

PROPOSALS = f"""
WITH p AS (SELECT conv_id || '-' || turn AS case_id, turn % 7 AS k, text FROM conversations),
quotes AS (SELECT item_id, text FROM benchmark),
made AS (SELECT case_id, k, CASE WHEN k = 0 THEN 'INVALID_JSON' WHEN k = 1 THEN '{S.SAFETY_GATE}' WHEN k IN (2, 4) OR len(list_filter({list(S.DENIED)}, lambda t: contains(text, t))) > 0 THEN '{S.ZERO_TRUST}' WHEN k = 3 THEN '{S.UNGROUNDED}' ELSE 'EXECUTE_SAFE' END AS decision FROM p)
"""


def proposals(spark, d):
    """JSON texts made from conversations, with a fixed share for each decision."""
    k = F.col("turn") % 7
    items = I.table(spark, d, "benchmark")
    item = F.pmod(F.col("conv_id"), F.col("n"))
    quotes = items.select("item_id", F.col("text").alias("quote"))
    body = F.to_json(F.struct(
        F.when(k == 5, "EXPLAIN").otherwise("REFACTOR").alias("Intent_Class"), F.when(k == 3, "missing.txt").otherwise(F.concat(F.lit("item_"), F.col("item").cast("string"))).alias("Target_File"),
        F.coalesce("quote", F.lit("")).alias("Topological_Grounding"), F.when(k == 2, F.concat("text", F.lit(" os.system('x')"))).when(k == 4, F.lit("a\0b")).otherwise(F.col("text")).alias("Implementation_Block"), F.when(k == 1, "SYNTAX_ERROR").otherwise("NONE").alias("Safety_Abort"),
    ))
    numbered = I.table(spark, d, "conversations").crossJoin(F.broadcast(items.agg((F.max("item_id") + 1).alias("n")))).withColumn("item", item)
    rows = numbered.join(quotes, F.col("item") == F.col("item_id"), "left")
    return rows.select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("case_id"), k.alias("k"), F.when(k == 0, F.substring(body, 2, 20)).otherwise(body).alias("raw"))


def damaged(spark, d):
    """The proposals, some in a fence and some without their last brace."""
    return proposals(spark, d).withColumn("raw", F.when(F.col("k") == 5, F.concat(F.lit("Here:\n```json\n"), "raw", F.lit("\n```"))).when(F.col("k") == 6, F.expr("left(raw, length(raw) - 1)")).otherwise(F.col("raw")))


def files(spark, d):
    return I.table(spark, d, "benchmark").select(F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("path"), F.col("text").cast("binary").alias("content"))


@query("q1_parse_proposals", PROPOSALS + "SELECT case_id, CASE k WHEN 0 THEN 'FAILED' WHEN 5 THEN 'EXTRACTED' WHEN 6 THEN 'REPAIRED' ELSE 'DIRECT' END AS status, k = 6 AS used_repair FROM made")
def _(spark, d):
    return S.parse_proposals(damaged(spark, d)).select("case_id", "status", "used_repair")


@query("q2_validate_proposals", PROPOSALS + "SELECT case_id, k <> 0 AND k <> 5 AS valid FROM made")
def _(spark, d):
    return S.validate_proposals(proposals(spark, d)).select("case_id", "valid")


@query("q2_proposal_outcome", PROPOSALS + "SELECT case_id, CASE WHEN k IN (0, 5) THEN 'PARSING_ERROR' WHEN k = 3 THEN 'VALIDATION_ERROR' ELSE 'VALID' END AS outcome FROM made")
def _(spark, d):
    # a wrong intent breaks the schema; without its last brace a text is read only by repair
    k, raw = F.col("k"), F.col("raw")
    broken = F.when(k == 3, F.replace(raw, F.lit('"REFACTOR"'), F.lit('"EXPLAIN"'))).when(k.isin(5, 6), F.expr("left(raw, length(raw) - 1)")).otherwise(raw)
    return S.proposal_outcome(proposals(spark, d).withColumn("raw", broken)).select("case_id", "outcome")


@query("q3_screen_proposals", PROPOSALS + "SELECT case_id, decision FROM made")
def _(spark, d):
    return S.screen_proposals(damaged(spark, d), files(spark, d)).select("case_id", "decision")


@query("q4_audit_append", PROPOSALS + "SELECT case_id, decision FROM made WHERE k <> 6")
def _(spark, d):
    decided = S.screen_proposals(damaged(spark, d), files(spark, d)).select("case_id", "k", "decision")
    return O.insert_or_ignore(decided.unionByName(decided.where("k = 5")), decided.where("k = 6"), ["case_id"]).select("case_id", "decision")


@query("q5_decision_counts", PROPOSALS + "SELECT decision, count(*) AS n FROM made GROUP BY 1")
def _(spark, d):
    return S.screen_proposals(damaged(spark, d), files(spark, d)).groupBy("decision").agg(F.count("*").alias("n"))
