"""Queries of gates, evidence, baselines, linkage, medoids, lists and merges over the proxy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import decisions, gates, signals
from ..sources.proxies import MEMBERS_SQL, MIN_SESSIONS, REPORTS_SQL, REVIEW_SESSIONS, WINDOW_SECONDS, embeddings, members, reports, table
from .registry import query

N = "INTERVAL 6 HOUR"
EVIDENCE_SQL = MEMBERS_SQL + f""", lasts AS (SELECT signal_id, max(received_at) AS last FROM members GROUP BY signal_id),
evidence AS (
  SELECT m.signal_id, count(report_id) AS raw_report_count, count(DISTINCT session_id) AS unique_sessions, min(received_at) AS first_report_at,
         max(received_at) AS last_report_at, max(purge_at) AS purge_at, count(DISTINCT session_id) >= {REVIEW_SESSIONS} AS review_priority,
         CASE WHEN count(DISTINCT session_id) >= {MIN_SESSIONS} THEN 'SIGNAL_DETECTED' ELSE 'CANDIDATE' END AS status
  FROM members m JOIN lasts USING (signal_id) WHERE received_at >= last - {N} GROUP BY m.signal_id
), clock AS (SELECT max(ts) AS now, min(ts) + INTERVAL 1 DAY AS policy_at FROM events)"""


def _now(spark: SparkSession, sf_dir: str):
    """The latest event time, a column of a one-row frame."""
    row = table(spark, sf_dir, "events").agg(F.max("ts").alias("now"), (F.min("ts") + F.expr("INTERVAL 1 DAY")).alias("policy_at")).first()
    return F.lit(row.now).cast("timestamp_ntz"), F.lit(row.policy_at).cast("timestamp_ntz")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.evidence(members(spark, sf_dir), WINDOW_SECONDS, MIN_SESSIONS, REVIEW_SESSIONS)


@query("scan_events", "SELECT event_id, user_id, event_type, value FROM events")
def scan_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")


@query("eligible_reports", f"WITH {REPORTS_SQL} SELECT report_id, issue_type, error_code, submission_status FROM reports WHERE symptom IS NOT NULL AND issue_type NOT IN ('UNKNOWN', 'UNRELATED_OR_AMBIGUOUS')")
def eligible_reports(spark, sf_dir):
    return reports(spark, sf_dir).filter(gates.is_eligible()).select("report_id", "issue_type", "error_code", "submission_status")


@query("signal_evidence", f"WITH {EVIDENCE_SQL} SELECT * FROM evidence")
def signal_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir)


@query(
    "hourly_volume",
    f"""WITH {EVIDENCE_SQL} SELECT date_trunc('hour', received_at) AS bucket_start, count(report_id) AS raw_report_count, count(DISTINCT session_id) AS unique_sessions
    FROM members m JOIN evidence e USING (signal_id) WHERE received_at >= last_report_at - {N} AND received_at <= last_report_at GROUP BY 1""",
)
def hourly_volume(spark, sf_dir):
    rows = members(spark, sf_dir)
    return signals.hourly_volume(rows, signals.evidence(rows, WINDOW_SECONDS, MIN_SESSIONS, REVIEW_SESSIONS), WINDOW_SECONDS)


BASELINE_SQL = EVIDENCE_SQL + f""", previous AS (
  SELECT m.signal_id, count(DISTINCT session_id) AS n FROM members m JOIN evidence USING (signal_id)
  WHERE received_at >= last_report_at - INTERVAL 12 HOUR AND received_at < last_report_at - {N} GROUP BY 1
), baselines AS (
  SELECT signal_id, unique_sessions, coalesce(n, 0) AS previous_sessions, last_report_at,
         CASE WHEN policy_at > last_report_at - INTERVAL 12 HOUR THEN 'INSUFFICIENT_HISTORY' WHEN coalesce(n, 0) = 0 THEN 'ZERO_BASELINE' ELSE 'AVAILABLE' END AS baseline_status
  FROM evidence LEFT JOIN previous USING (signal_id), clock
)"""


@query(
    "baseline_ratio",
    f"WITH {BASELINE_SQL} SELECT signal_id, unique_sessions, previous_sessions, baseline_status, CASE WHEN baseline_status = 'AVAILABLE' THEN unique_sessions / previous_sessions END AS baseline_ratio FROM baselines",
)
def baseline_ratio(spark, sf_dir):
    rows = members(spark, sf_dir)
    _, policy_at = _now(spark, sf_dir)
    return signals.baseline(rows, signals.evidence(rows, WINDOW_SECONDS, MIN_SESSIONS, REVIEW_SESSIONS), WINDOW_SECONDS, policy_at)


@query(
    "dashboard_baseline",
    f"""WITH {BASELINE_SQL}, page AS (SELECT b.* FROM baselines b, clock WHERE last_report_at + INTERVAL 10 DAY >= now)
    SELECT CASE WHEN count(*) = 0 OR bool_or(baseline_status = 'INSUFFICIENT_HISTORY') THEN 'INSUFFICIENT_HISTORY' WHEN sum(previous_sessions) = 0 THEN 'ZERO_BASELINE' ELSE 'AVAILABLE' END AS baseline_status,
           CASE WHEN count(*) > 0 AND NOT bool_or(baseline_status = 'INSUFFICIENT_HISTORY') AND sum(previous_sessions) > 0 THEN sum(unique_sessions) / sum(previous_sessions) END AS baseline_ratio FROM page""",
)
def dashboard_baseline(spark, sf_dir):
    now, policy_at = _now(spark, sf_dir)
    rows = members(spark, sf_dir)
    found = signals.evidence(rows, WINDOW_SECONDS, MIN_SESSIONS, REVIEW_SESSIONS)
    recent = found.filter(F.col("last_report_at") + F.expr("INTERVAL 10 DAYS") >= now)
    return signals.dashboard_baseline(signals.baseline(rows, recent, WINDOW_SECONDS, policy_at))


@query("public_signals", f"WITH {EVIDENCE_SQL} SELECT signal_id, status, last_report_at FROM evidence, clock WHERE status = 'SIGNAL_DETECTED' AND last_report_at + INTERVAL 3 DAY >= now")
def public_signals(spark, sf_dir):
    now, _ = _now(spark, sf_dir)
    found = _evidence(spark, sf_dir)
    return found.filter(gates.is_public(F.col("status"), F.col("last_report_at"), F.lit(3 * 86_400), now)).select("signal_id", "status", "last_report_at")


@query(
    "dashboard_items",
    f"""WITH {EVIDENCE_SQL} SELECT signal_id, status, unique_sessions, raw_report_count, review_priority, first_report_at, last_report_at FROM evidence, clock
    WHERE status = 'SIGNAL_DETECTED' AND last_report_at + INTERVAL 10 DAY >= now ORDER BY last_report_at DESC, signal_id LIMIT 20 OFFSET 5""",
)
def dashboard_items(spark, sf_dir):
    now, _ = _now(spark, sf_dir)
    page = signals.dashboard_items(_evidence(spark, sf_dir), now, 10 * 86_400, 20, 5)
    return page.select("signal_id", "status", "unique_sessions", "raw_report_count", "review_priority", "first_report_at", "last_report_at")


@query(
    "operator_signals",
    f"""WITH {EVIDENCE_SQL}, representative AS (SELECT signal_id, min(report_id) AS representative_id FROM members WHERE k % 5 = 0 GROUP BY 1)
    SELECT e.signal_id, e.status, r.symptom AS representative_text, e.last_report_at + {N} AS window_expires_at,
           e.status = 'SIGNAL_DETECTED' AND e.last_report_at + {N} >= now AS public_visible
    FROM evidence e CROSS JOIN clock LEFT JOIN representative p USING (signal_id) LEFT JOIN reports r ON r.report_id = p.representative_id
    ORDER BY e.last_report_at DESC, e.signal_id LIMIT 50""",
)
def operator_signals(spark, sf_dir):
    now, _ = _now(spark, sf_dir)
    rows = members(spark, sf_dir)
    chosen = rows.filter("k % 5 = 0").groupBy("signal_id").agg(F.min("report_id").alias("representative_id"))
    found = _evidence(spark, sf_dir).join(chosen, "signal_id", "left")
    symptoms = reports(spark, sf_dir).select(F.col("report_id").alias("representative_id"), F.col("symptom").alias("representative_text"))
    page = signals.operator_signals(found, symptoms, now, WINDOW_SECONDS)
    return page.select("signal_id", "status", "representative_text", "window_expires_at", "public_visible")


@query("window_expiry", f"WITH {EVIDENCE_SQL} SELECT signal_id, last_report_at + {N} AS window_expires_at, last_report_at + {N} < now AS expired FROM evidence, clock")
def window_expiry(spark, sf_dir):
    now, _ = _now(spark, sf_dir)
    at = F.col("last_report_at") + signals.interval(WINDOW_SECONDS)
    return _evidence(spark, sf_dir).select("signal_id", at.alias("window_expires_at"), (at < now).alias("expired"))


@query(
    "window_pairs",
    f"WITH {REPORTS_SQL} SELECT a.issue_type, a.report_id AS left_id, b.report_id AS right_id, abs(epoch_us(a.received_at) - epoch_us(b.received_at)) / 1000000.0 AS gap "
    "FROM reports a JOIN reports b ON a.issue_type = b.issue_type AND a.report_id < b.report_id AND a.received_at BETWEEN b.received_at - INTERVAL 600 SECOND AND b.received_at + INTERVAL 600 SECOND",
)
def window_pairs(spark, sf_dir):
    return gates.window_pairs(reports(spark, sf_dir), 600, ["issue_type"])


@query(
    "gate_pairs",
    f"""WITH {REPORTS_SQL}, filters AS (SELECT *, nullif(submission_status, 'UNKNOWN') AS submission_filter FROM reports WHERE issue_type <> 'UNKNOWN')
    SELECT a.issue_type, a.received_at::DATE AS day, a.report_id, b.report_id AS report_id_r FROM filters a JOIN filters b ON a.issue_type = b.issue_type AND a.received_at::DATE = b.received_at::DATE
    AND (a.submission_filter IS NULL OR b.submission_filter IS NULL OR a.submission_filter = b.submission_filter)
    AND (a.error_code IS NULL OR b.error_code IS NULL OR a.error_code = b.error_code) WHERE a.report_id < b.report_id""",
)
def gate_pairs(spark, sf_dir):
    rows = gates.known_filters(members(spark, sf_dir)).withColumn("day", F.to_date("received_at"))
    rows = rows.select("issue_type", "day", "report_id", "submission_filter", "error_filter")
    met = gates.gate_pairs(rows, rows, ["issue_type", "day"], ["submission_filter", "error_filter"], "report_id")
    return met.select("issue_type", "day", "report_id", "report_id_r")


@query("embedding_valid", "SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS valid FROM embeddings")
def embedding_valid(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", V.is_valid(F.col("vec"), 64).alias("valid"))


VECTORS_SQL = "vecs AS (SELECT vec_id, embedding::DOUBLE[] AS vec, label FROM embeddings)"


def _linkage_inputs(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    candidates = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("candidate_id"), "vec", F.lit(1).alias("gate"))
    held = rows.select(F.col("label").alias("signal_id"), F.col("vec_id").alias("member_id"), F.col("vec").alias("member_vec"), F.lit(1).alias("gate"))
    return candidates, held


@query(
    "linkage_scores",
    f"""WITH {VECTORS_SQL}, scores AS (SELECT c.vec_id AS candidate_id, m.label AS signal_id, round(avg(list_cosine_similarity(c.vec, m.vec)), 6) AS similarity
    FROM vecs c JOIN vecs m ON m.vec_id <> c.vec_id WHERE c.vec_id % 20 = 0 GROUP BY 1, 2)
    SELECT candidate_id, signal_id, similarity FROM scores QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY similarity DESC, signal_id) = 1""",
)
def linkage_scores(spark, sf_dir):
    candidates, held = _linkage_inputs(spark, sf_dir)
    return signals.best_signal(signals.linkage_scores(candidates, held, ["gate"]), 6)


@query(
    "nearest_member",
    f"""WITH {VECTORS_SQL} SELECT c.vec_id AS candidate_id, m.label AS signal_id, m.vec_id AS member_id, round(list_cosine_similarity(c.vec, m.vec), 6) AS similarity
    FROM vecs c JOIN vecs m ON m.vec_id <> c.vec_id WHERE c.vec_id % 20 = 0
    QUALIFY row_number() OVER (PARTITION BY c.vec_id ORDER BY round(list_cosine_similarity(c.vec, m.vec), 6) DESC, m.label, m.vec_id) = 1""",
)
def nearest_member(spark, sf_dir):
    candidates, held = _linkage_inputs(spark, sf_dir)
    return signals.nearest_member(candidates, held, ["gate"], 6)


@query(
    "medoid",
    f"""WITH {VECTORS_SQL}, scores AS (SELECT a.label AS signal_id, a.vec_id AS member_id, round(avg(list_cosine_similarity(a.vec, b.vec)), 6) AS score FROM vecs a JOIN vecs b USING (label) GROUP BY 1, 2)
    SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY score DESC, member_id) = 1""",
)
def medoid(spark, sf_dir):
    rows = embeddings(spark, sf_dir).select(F.col("label").alias("signal_id"), F.col("vec_id").alias("member_id"), "vec")
    return signals.medoid(rows, digits=6)


@query(
    "text_medoid",
    f"""WITH {VECTORS_SQL}, rows AS (SELECT label AS group_id, vec_id, 'symptom ' || (vec_id % 7) AS text, vec FROM vecs),
    scores AS (SELECT a.group_id, a.vec_id, a.text, round(avg(list_cosine_similarity(a.vec, b.vec)), 6) AS score FROM rows a JOIN rows b ON a.group_id = b.group_id AND a.vec_id <> b.vec_id GROUP BY 1, 2, 3)
    SELECT group_id, text FROM scores QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY score DESC, text DESC) = 1""",
)
def text_medoid(spark, sf_dir):
    rows = embeddings(spark, sf_dir).select(F.col("label").alias("group_id"), F.concat(F.lit("symptom "), (F.col("vec_id") % 7).cast("string")).alias("text"), "vec")
    return signals.text_medoid(rows, 6)


@query(
    "group_mode",
    f"""WITH {REPORTS_SQL}, counts AS (SELECT k AS group_id, issue_type, count(*) AS n, min(report_id) AS first FROM reports GROUP BY 1, 2)
    SELECT group_id, issue_type FROM counts QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY n DESC, first) = 1""",
)
def group_mode(spark, sf_dir):
    return signals.group_mode(reports(spark, sf_dir).withColumnRenamed("k", "group_id"), "report_id")


@query("group_distribution", f"WITH {REPORTS_SQL} SELECT k AS group_id, issue_type, count(*) AS n FROM reports GROUP BY 1, 2")
def group_distribution(spark, sf_dir):
    return reports(spark, sf_dir).groupBy(F.col("k").alias("group_id"), "issue_type").agg(F.count("*").alias("n"))


@query(
    "signal_state",
    f"""WITH {EVIDENCE_SQL}, prior AS (SELECT signal_id, unique_sessions, CASE length(signal_id) % 3 WHEN 0 THEN 'CANDIDATE' WHEN 1 THEN 'SIGNAL_DETECTED' ELSE 'UNDER_REVIEW' END AS before, raw_report_count % 2 = 0 AS deleted FROM evidence)
    SELECT signal_id, before, CASE WHEN deleted AND unique_sessions < 12 THEN 'CLOSED' WHEN before = 'CANDIDATE' AND unique_sessions >= 12 THEN 'SIGNAL_DETECTED'
      WHEN before = 'SIGNAL_DETECTED' AND unique_sessions < 12 THEN 'CANDIDATE' ELSE before END AS after FROM prior""",
)
def signal_state(spark, sf_dir):
    before = F.element_at(F.array(F.lit("CANDIDATE"), F.lit("SIGNAL_DETECTED"), F.lit("UNDER_REVIEW")), F.length("signal_id") % 3 + 1)
    rows = _evidence(spark, sf_dir).withColumn("before", before)
    after = signals.next_state(F.col("before"), F.col("unique_sessions"), F.lit(12), F.col("raw_report_count") % 2 == 0)
    return rows.select("signal_id", "before", after.alias("after"))


@query("mergeable_clusters", f"WITH {EVIDENCE_SQL}, locks AS (SELECT DISTINCT signal_id FROM members WHERE k = 7) SELECT signal_id, status FROM evidence e WHERE NOT EXISTS (SELECT 1 FROM locks l WHERE l.signal_id = e.signal_id)")
def mergeable_clusters(spark, sf_dir):
    locks = members(spark, sf_dir).filter("k = 7").select("signal_id").distinct()
    return signals.mergeable(_evidence(spark, sf_dir), locks).select("signal_id", "status")


@query(
    "merge_signals",
    f"""WITH {MEMBERS_SQL}, ends AS (SELECT min(signal_id) AS target, max(signal_id) AS source FROM members)
    SELECT CASE WHEN signal_id = source THEN target ELSE signal_id END AS signal_id, count(*) AS reports, count(DISTINCT session_id) AS sessions FROM members, ends GROUP BY 1""",
)
def merge_signals(spark, sf_dir):
    rows = members(spark, sf_dir)
    ends = rows.agg(F.min("signal_id").alias("target"), F.max("signal_id").alias("source")).first()
    return signals.merge(rows, ends.source, ends.target).groupBy("signal_id").agg(F.count("*").alias("reports"), F.count_distinct("session_id").alias("sessions"))


@query(
    "split_signal",
    f"""WITH {MEMBERS_SQL}, s AS (SELECT max(signal_id) AS source FROM members)
    SELECT CASE WHEN signal_id = source AND k % 2 = 0 THEN 'NEW' ELSE signal_id END AS signal_id, count(*) AS reports, min(received_at) AS first_report_at, max(received_at) AS last_report_at, max(purge_at) AS purge_at FROM members, s GROUP BY 1""",
)
def split_signal(spark, sf_dir):
    rows = members(spark, sf_dir)
    source = rows.agg(F.max("signal_id").alias("s")).first().s
    chosen = rows.filter((F.col("signal_id") == source) & (F.col("k") % 2 == 0))
    return signals.split(rows, chosen, source, "NEW").groupBy("signal_id").agg(
        F.count("*").alias("reports"), F.min("received_at").alias("first_report_at"), F.max("received_at").alias("last_report_at"), F.max("purge_at").alias("purge_at")
    )


# Signals in order of their ids within sixteen parts. Some are closed, some have a filter. They are merged three by three: two
# into one, a chain from its end, and a chain from its head, where the second request meets a closed signal.
STATES_SQL = EVIDENCE_SQL + """, signals AS (
  SELECT e.*, split_part(e.signal_id, '|', 1) AS issue_type, CASE WHEN raw_report_count % 11 = 0 THEN 'CLOSED' ELSE e.status END AS state,
         CASE raw_report_count % 4 WHEN 0 THEN 'E1' WHEN 1 THEN 'E2' END AS error_filter, left(md5(e.signal_id), 1) AS part,
         row_number() OVER (PARTITION BY left(md5(e.signal_id), 1) ORDER BY e.signal_id) - 1 AS n FROM evidence e
)"""
_STEPS = ((0, 1, 1, 0), (0, 2, 2, 0), (1, 1, 2, 1), (1, 2, 1, 0), (2, 1, 1, 0), (2, 2, 2, 1))
_OUTCOME = """CASE WHEN {s}.{state} = 'CLOSED' OR {t}.{state} = 'CLOSED' THEN 'INVALID_SIGNAL_STATE'
  WHEN {s}.issue_type <> {t}.issue_type OR {s}.{filter} <> {t}.{filter} THEN 'SIGNAL_GATE_CONFLICT' ELSE 'MERGED' END"""
MERGES_SQL = STATES_SQL + f""", placed AS (SELECT *, part || '-' || (n // 3) AS trio, n % 3 AS place, (n // 3) % 3 AS kind FROM signals
), steps AS (SELECT * FROM (VALUES {", ".join(map(str, _STEPS))}) AS v(kind, step, source_place, target_place)
), asked AS (
  SELECT p.trio, step, p.signal_id AS source_id, t.signal_id AS target_id
  FROM placed p JOIN steps USING (kind) JOIN placed t ON t.trio = p.trio AND t.place = target_place WHERE p.place = source_place
), first AS (
  SELECT a.*, s.error_filter AS given, s.state AS before, {_OUTCOME.format(s="s", t="t", state="state", filter="error_filter")} AS outcome
  FROM asked a JOIN placed s ON s.signal_id = a.source_id JOIN placed t ON t.signal_id = a.target_id WHERE step = 1
), later AS (
  SELECT p.*, CASE WHEN o.source_id IS NOT NULL THEN 'CLOSED' ELSE state END AS state1, coalesce(error_filter, i.given) AS filter1
  FROM placed p LEFT JOIN first o ON o.source_id = p.signal_id AND o.outcome = 'MERGED' LEFT JOIN first i ON i.target_id = p.signal_id AND i.outcome = 'MERGED'
), second AS (
  SELECT a.*, s.filter1 AS given, s.state AS before, {_OUTCOME.format(s="s", t="t", state="state1", filter="filter1")} AS outcome
  FROM asked a JOIN later s ON s.signal_id = a.source_id JOIN later t ON t.signal_id = a.target_id WHERE step = 2
), judged AS (SELECT * FROM first UNION ALL SELECT * FROM second
), done AS (SELECT * FROM judged WHERE outcome = 'MERGED'
), moves AS (SELECT d.source_id, d.step, coalesce(e.target_id, d.target_id) AS root FROM done d LEFT JOIN done e ON e.source_id = d.target_id AND e.step > d.step)"""


def _states(spark, sf_dir):
    """(signals, members): the evidence with a closed state and an error filter of some, and a number in order of ids within a part."""
    n = F.col("raw_report_count")
    found = _evidence(spark, sf_dir).withColumn("issue_type", F.split_part("signal_id", F.lit("|"), F.lit(1)))
    found = found.withColumn("status", F.when(n % 11 == 0, "CLOSED").otherwise(F.col("status"))).withColumn("closure_reason", F.lit(None).cast("string"))
    found = found.withColumn("error_filter", F.when(n % 4 == 0, "E1").when(n % 4 == 1, "E2")).withColumn("closed_at", F.lit(None).cast("timestamp_ntz"))
    return found, members(spark, sf_dir).select("signal_id", "report_id", "session_id", "received_at", "purge_at", "k")


def _numbered(found):
    part = F.left(F.md5(F.col("signal_id").cast("binary")), F.lit(1))
    rows = found.select("signal_id", part.alias("part"))
    return rows.withColumn("n", (F.row_number().over(W.partitionBy("part").orderBy("signal_id")) - 1).cast("int"))


def _asked(source, target, step):
    """A number for the request, in order of the step within its trio, and who asked when and why."""
    digest = F.conv(F.substring(F.md5(F.concat(source, F.lit(">"), target).cast("binary")), 1, 12), 16, 10).cast("long")
    return [(digest * 4 + step).alias("request_id"), (F.lit("2026-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=step)).alias("at"), F.lit("operator").alias("actor_id"), F.lit("same cause").alias("reason")]


def _merged(spark, sf_dir):
    found, rows = _states(spark, sf_dir)
    ids = _numbered(found).select("signal_id", F.concat_ws("-", "part", F.floor(F.col("n") / 3).cast("string")).alias("trio"), (F.col("n") % 3).alias("place"), (F.floor(F.col("n") / 3) % 3).cast("int").alias("kind"))
    steps = F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(s, ("kind", "step", "source_place", "target_place"), strict=True)]) for s in _STEPS])
    sources = ids.withColumn("s", F.explode(steps)).filter("s.kind = kind AND s.source_place = place")
    targets = ids.select("trio", F.col("place").alias("target_place"), F.col("signal_id").alias("target_id"))
    pairs = sources.select("trio", F.col("s.target_place").alias("target_place"), F.col("s.step").alias("step"), F.col("signal_id").alias("source_id")).join(targets, ["trio", "target_place"])
    # The number must rise with the step within a trio, so the digest is the trio's.
    requests = pairs.select("source_id", "target_id", *_asked(F.col("trio"), F.lit(""), F.col("step")))
    return signals.apply_merges(found, rows, requests, ["issue_type"], ["error_filter"], WINDOW_SECONDS, MIN_SESSIONS, REVIEW_SESSIONS)


@query(
    "merge_state",
    f"""WITH {MERGES_SQL}, moved AS (SELECT coalesce(d.root, m.signal_id) AS signal_id, report_id, session_id, received_at FROM members m LEFT JOIN moves d ON d.source_id = m.signal_id
    ), ends AS (SELECT signal_id, max(received_at) AS last FROM moved GROUP BY 1
    ), fresh AS (SELECT signal_id, count(report_id) AS raw, count(DISTINCT session_id) AS sessions, min(received_at) AS first_at, max(received_at) AS last_at FROM moved JOIN ends USING (signal_id) WHERE received_at >= last - {N} GROUP BY 1
    ), filled AS (SELECT l.*, coalesce(filter1, d.given) AS filter2 FROM later l LEFT JOIN second d ON d.target_id = l.signal_id AND d.outcome = 'MERGED'
    ), roots AS (SELECT DISTINCT root FROM moves)
    SELECT s.signal_id, coalesce(j.outcome, 'TARGET') AS outcome, filter2 AS error_filter,
      CASE WHEN m.root IS NOT NULL THEN 'MERGED' END AS closure_reason, CASE WHEN m.root IS NOT NULL THEN TIMESTAMP '2026-01-01 00:00:00' + m.step * INTERVAL 1 HOUR END AS closed_at,
      CASE WHEN m.root IS NOT NULL THEN 'CLOSED' WHEN r.root IS NULL THEN s.state WHEN s.state = 'CANDIDATE' AND f.sessions >= {MIN_SESSIONS} THEN 'SIGNAL_DETECTED' WHEN s.state = 'SIGNAL_DETECTED' AND f.sessions < {MIN_SESSIONS} THEN 'CANDIDATE' ELSE s.state END AS status,
      CASE WHEN m.root IS NOT NULL THEN 0 WHEN r.root IS NULL THEN raw_report_count ELSE f.raw END AS raw_report_count,
      CASE WHEN m.root IS NOT NULL THEN 0 WHEN r.root IS NULL THEN unique_sessions ELSE f.sessions END AS unique_sessions,
      CASE WHEN m.root IS NOT NULL THEN false WHEN r.root IS NULL THEN review_priority ELSE f.sessions >= {REVIEW_SESSIONS} END AS review_priority,
      CASE WHEN r.root IS NULL THEN first_report_at ELSE f.first_at END AS first_report_at, CASE WHEN r.root IS NULL THEN last_report_at ELSE f.last_at END AS last_report_at
    FROM filled s LEFT JOIN judged j ON j.source_id = s.signal_id LEFT JOIN moves m ON m.source_id = s.signal_id LEFT JOIN roots r ON r.root = s.signal_id LEFT JOIN fresh f ON f.signal_id = s.signal_id""",
)
def merge_state(spark, sf_dir):
    """What becomes of all signals when they are merged three by three, with chains and refusals: outcomes, states, filters and evidence."""
    out = _merged(spark, sf_dir)
    outcomes = out["outcomes"].select(F.col("source_id").alias("signal_id"), "outcome")
    columns = ["error_filter", "closure_reason", "closed_at", "status", "raw_report_count", "unique_sessions", "review_priority", "first_report_at", "last_report_at"]
    return out["signals"].join(outcomes, "signal_id", "left").select("signal_id", F.coalesce("outcome", F.lit("TARGET")).alias("outcome"), *columns)


@query(
    "merge_events",
    f"""WITH {MERGES_SQL} SELECT 'SIGNAL_MERGED' AS action, source_id AS signal_id, target_id AS target_signal_id, 'operator' AS actor_id, before AS before_status, 'CLOSED' AS after_status,
      'same cause' AS reason, TIMESTAMP '2026-01-01 00:00:00' + step * INTERVAL 1 HOUR AS created_at FROM done""",
)
def merge_events(spark, sf_dir):
    return _merged(spark, sf_dir)["events"].drop("request_id", "actor_type")


SPLITS_SQL = STATES_SQL + f""", asked AS (
  SELECT s.signal_id AS source_id, s.signal_id || '|NEW' AS new_id, m.report_id FROM signals s JOIN members m USING (signal_id) WHERE CASE s.n % 3 WHEN 0 THEN m.k % 2 = 0 WHEN 1 THEN true ELSE m.k % 5 < 3 END
  UNION ALL SELECT signal_id, signal_id || '|NEW', -1 FROM signals WHERE n % 7 = 0
), counted AS (SELECT source_id, new_id, count(*) AS chosen, count(*) FILTER (WHERE report_id >= 0) AS found FROM asked GROUP BY 1, 2
), sizes AS (SELECT signal_id, count(*) AS size FROM members GROUP BY 1
), judged AS (SELECT c.*, CASE WHEN s.state = 'CLOSED' THEN 'INVALID_SIGNAL_STATE' WHEN found < chosen THEN 'SIGNAL_MEMBER_NOT_FOUND' WHEN found = size THEN 'EMPTY_SOURCE_SIGNAL' ELSE 'SPLIT' END AS outcome
  FROM counted c JOIN signals s ON s.signal_id = c.source_id JOIN sizes z ON z.signal_id = c.source_id
), done AS (SELECT * FROM judged WHERE outcome = 'SPLIT'
), moved AS (SELECT coalesce(a.new_id, m.signal_id) AS signal_id, m.report_id, session_id, received_at FROM members m LEFT JOIN (SELECT a.* FROM asked a JOIN done USING (source_id)) a ON a.source_id = m.signal_id AND a.report_id = m.report_id
), ends AS (SELECT signal_id, max(received_at) AS last FROM moved GROUP BY 1
), fresh AS (SELECT signal_id, count(report_id) AS raw, count(DISTINCT session_id) AS sessions, min(received_at) AS first_at, max(received_at) AS last_at FROM moved JOIN ends USING (signal_id) WHERE received_at >= last - {N} GROUP BY 1
), every AS (SELECT signal_id, state, raw_report_count, unique_sessions, first_report_at, last_report_at, (SELECT outcome FROM judged j WHERE j.source_id = s.signal_id) AS outcome, signal_id IN (SELECT source_id FROM done) AS touched, false AS made FROM signals s
  UNION ALL SELECT new_id, 'CANDIDATE', 0, 0, NULL, NULL, 'NEW', true, true FROM done
), parted AS (SELECT e.signal_id, coalesce(outcome, 'NONE') AS outcome, CASE WHEN touched THEN f.raw ELSE raw_report_count END AS raw_report_count, CASE WHEN touched THEN f.sessions ELSE unique_sessions END AS unique_sessions,
  CASE WHEN touched THEN f.first_at ELSE first_report_at END AS first_report_at, CASE WHEN touched THEN f.last_at ELSE last_report_at END AS last_report_at,
  CASE WHEN NOT touched THEN state WHEN NOT made AND f.sessions < {MIN_SESSIONS} THEN 'CLOSED' WHEN state = 'CANDIDATE' AND f.sessions >= {MIN_SESSIONS} THEN 'SIGNAL_DETECTED' ELSE state END AS status,
  CASE WHEN touched AND NOT made AND f.sessions < {MIN_SESSIONS} THEN 'EVIDENCE_RECALCULATED' END AS closure_reason,
  CASE WHEN touched AND NOT made AND f.sessions < {MIN_SESSIONS} THEN TIMESTAMP '2026-01-01 01:00:00' END AS closed_at
FROM every e LEFT JOIN fresh f ON f.signal_id = e.signal_id)"""


def _parted(spark, sf_dir):
    found, rows = _states(spark, sf_dir)
    ids = _numbered(found)
    chosen = rows.join(ids, "signal_id").filter(F.when(F.col("n") % 3 == 0, F.col("k") % 2 == 0).when(F.col("n") % 3 == 1, True).otherwise(F.col("k") % 5 < 3))
    asked = chosen.select("signal_id", "report_id").unionByName(ids.filter("n % 7 = 0").select("signal_id", F.lit(-1).cast("long").alias("report_id")))
    source, new = F.col("signal_id"), F.concat("signal_id", F.lit("|NEW"))
    requests = asked.select(source.alias("source_id"), new.alias("new_id"), "report_id", *_asked(source, new, F.lit(1)))
    return signals.apply_splits(found, rows, requests, WINDOW_SECONDS, MIN_SESSIONS, REVIEW_SESSIONS)


@query("split_state", f"WITH {SPLITS_SQL} SELECT * FROM parted")
def split_state(spark, sf_dir):
    """Splits of all signals, with refused ones: closed sources, reports that are no members, and all members at once."""
    out = _parted(spark, sf_dir)
    outcomes = out["outcomes"].select(F.col("source_id").alias("signal_id"), "outcome")
    made = out["outcomes"].filter("outcome = 'SPLIT'").select(F.col("new_id").alias("signal_id"), F.lit("NEW").alias("outcome"))
    columns = ["raw_report_count", "unique_sessions", "first_report_at", "last_report_at", "status", "closure_reason", "closed_at"]
    return out["signals"].join(outcomes.unionByName(made), "signal_id", "left").select("signal_id", F.coalesce("outcome", F.lit("NONE")).alias("outcome"), *columns)


@query("split_events", f"""WITH {SPLITS_SQL} SELECT 'SIGNAL_SPLIT' AS action, d.source_id AS signal_id, d.new_id AS target_signal_id, p.status AS before_status, p.status AS after_status, TIMESTAMP '2026-01-01 01:00:00' AS created_at
    FROM done d JOIN parted p ON p.signal_id = d.source_id""")
def split_events(spark, sf_dir):
    return _parted(spark, sf_dir)["events"].drop("request_id", "actor_type", "actor_id", "reason")


@query(
    "purge_signals",
    f"""WITH {STATES_SQL}, gone AS (SELECT DISTINCT signal_id FROM members, clock WHERE purge_at <= now), kept AS (SELECT m.* FROM members m, clock WHERE purge_at > now),
    ends AS (SELECT signal_id, max(received_at) AS last FROM kept GROUP BY 1),
    fresh AS (SELECT signal_id, count(report_id) AS raw, count(DISTINCT session_id) AS sessions, min(received_at) AS first_at, max(received_at) AS last_at FROM kept JOIN ends USING (signal_id) WHERE received_at >= last - {N} GROUP BY 1),
    judged AS (SELECT s.*, f.*, g.signal_id IS NOT NULL AS hit, coalesce(f.sessions, 0) < {MIN_SESSIONS} AS few FROM signals s LEFT JOIN gone g USING (signal_id) LEFT JOIN fresh f USING (signal_id))
    SELECT signal_id, CASE WHEN NOT hit THEN state WHEN few THEN 'CLOSED' WHEN state = 'CANDIDATE' THEN 'SIGNAL_DETECTED' ELSE state END AS status,
      CASE WHEN hit AND few AND state <> 'CLOSED' THEN 'EVIDENCE_RECALCULATED' END AS closure_reason, CASE WHEN hit AND few AND state <> 'CLOSED' THEN now END AS closed_at,
      CASE WHEN hit THEN coalesce(raw, 0) ELSE raw_report_count END AS raw_report_count, CASE WHEN hit THEN coalesce(sessions, 0) ELSE unique_sessions END AS unique_sessions,
      CASE WHEN hit THEN coalesce(sessions >= {REVIEW_SESSIONS}, false) ELSE review_priority END AS review_priority,
      CASE WHEN hit THEN coalesce(first_at, first_report_at) ELSE first_report_at END AS first_report_at, CASE WHEN hit THEN coalesce(last_at, last_report_at) ELSE last_report_at END AS last_report_at
    FROM judged, clock""",
)
def purge_signals(spark, sf_dir):
    """Every signal after the reports past their retention went."""
    now, _ = _now(spark, sf_dir)
    found, rows = _states(spark, sf_dir)
    out = signals.detach_reports(found, rows, rows.filter(F.col("purge_at") <= now), now, WINDOW_SECONDS, MIN_SESSIONS, REVIEW_SESSIONS)
    return out["signals"].select("signal_id", "status", "closure_reason", "closed_at", "raw_report_count", "unique_sessions", "review_priority", "first_report_at", "last_report_at")


# Registrations and approvals, one a customer, of a tenth as many versions.
_POLICY_SQL = """events AS (SELECT c_custkey AS event_id, CASE WHEN c_custkey % 3 = 0 THEN 'APPROVE' ELSE 'REGISTER' END AS kind, 'v' || (c_custkey * 7 % (SELECT greatest(5, count(*) // 10) FROM customer)) AS policy_version, c_custkey % 4 <> 1 AS activate FROM customer),
entered AS (SELECT *, row_number() OVER (PARTITION BY policy_version ORDER BY event_id) = 1 AS fresh FROM events WHERE kind = 'REGISTER'),
approvals AS (SELECT a.event_id, a.policy_version, (SELECT max(event_id) FROM entered e WHERE fresh AND e.policy_version = a.policy_version AND e.event_id < a.event_id) AS known,
  (SELECT arg_max(policy_version, event_id) FROM entered e WHERE fresh AND activate AND e.event_id < a.event_id) = a.policy_version AS active FROM events a WHERE kind = 'APPROVE'),
judged AS (SELECT event_id, policy_version, 'APPROVE' AS kind, CASE WHEN known IS NULL THEN 'SIGNAL_POLICY_NOT_FOUND'
    WHEN EXISTS (SELECT 1 FROM approvals b WHERE b.policy_version = a.policy_version AND b.active AND b.event_id < a.event_id) THEN 'INVALID_SIGNAL_POLICY_STATE'
    WHEN NOT coalesce(active, false) THEN 'SIGNAL_POLICY_NOT_ACTIVE' ELSE 'APPROVED' END AS outcome FROM approvals a
  UNION ALL SELECT event_id, policy_version, 'REGISTER', CASE WHEN fresh THEN 'REGISTERED' ELSE 'POLICY_VERSION_EXISTS' END FROM entered)"""


def _policies(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    versions = max(5, rows.count() // 10)
    key = F.col("c_custkey")
    events = rows.select(
        key.cast("long").alias("event_id"), F.when(key % 3 == 0, "APPROVE").otherwise("REGISTER").alias("kind"), F.concat(F.lit("v"), (key * 7 % versions).cast("string")).alias("policy_version"),
        (key % 4 != 1).alias("activate"), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz").alias("at"), F.lit("operator").alias("actor_id"), F.sha2(key.cast("string"), 256).alias("evidence_sha256"),
    )
    return decisions.policy_log(events)


@query("policy_outcomes", f"WITH {_POLICY_SQL} SELECT * FROM judged")
def policy_outcomes(spark, sf_dir):
    """What becomes of registrations and approvals of policies, in order, with all refusals."""
    return _policies(spark, sf_dir)["outcomes"]


@query("policy_states", f"""WITH {_POLICY_SQL} SELECT r.policy_version, CASE WHEN a.event_id IS NULL THEN 'EXPERIMENTAL' ELSE 'APPROVED' END AS status,
    r.policy_version = (SELECT arg_max(policy_version, event_id) FROM entered WHERE fresh AND activate) AS is_active, sha256(CAST(a.event_id AS VARCHAR)) AS evidence_sha256
    FROM judged r LEFT JOIN judged a ON a.policy_version = r.policy_version AND a.outcome = 'APPROVED' WHERE r.outcome = 'REGISTERED'""")
def policy_states(spark, sf_dir):
    return _policies(spark, sf_dir)["policies"].select("policy_version", "status", "is_active", "evidence_sha256")


@query(
    "detach_report",
    f"""WITH {MEMBERS_SQL}, gone AS (SELECT * FROM members WHERE k % 4 = 1), kept AS (SELECT * FROM members WHERE k % 4 <> 1),
    lasts AS (SELECT signal_id, max(received_at) AS last FROM kept GROUP BY 1),
    counts AS (SELECT k.signal_id, count(*) AS raw, count(DISTINCT session_id) AS uniq FROM kept k JOIN lasts USING (signal_id) WHERE received_at >= last - {N} GROUP BY 1)
    SELECT t.signal_id, coalesce(raw, 0) AS raw_report_count, coalesce(uniq, 0) AS unique_sessions, CASE WHEN coalesce(uniq, 0) < 12 THEN 'CLOSED' ELSE 'SIGNAL_DETECTED' END AS status,
      CASE WHEN coalesce(uniq, 0) < 12 THEN 'EVIDENCE_RECALCULATED' END AS closure_reason
    FROM (SELECT DISTINCT signal_id FROM gone) t LEFT JOIN counts USING (signal_id)""",
)
def detach_report(spark, sf_dir):
    rows = members(spark, sf_dir)
    out = signals.detach(rows, rows.filter("k % 4 = 1"), WINDOW_SECONDS, 12, REVIEW_SESSIONS)
    return out.select("signal_id", "raw_report_count", "unique_sessions", "status", "closure_reason")


@query(
    "related_signals",
    f"""WITH {EVIDENCE_SQL} SELECT m.report_id, m.signal_id, e.status, e.last_report_at + INTERVAL 3 DAY >= now AS visible FROM members m JOIN evidence e USING (signal_id), clock""",
)
def related_signals(spark, sf_dir):
    now, _ = _now(spark, sf_dir)
    found = _evidence(spark, sf_dir).select("signal_id", "status", (F.col("last_report_at") + F.expr("INTERVAL 3 DAYS") >= now).alias("visible"))
    return members(spark, sf_dir).join(found, "signal_id").select("report_id", "signal_id", "status", "visible")


@query("vector_codec", """SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding::DOUBLE[], lambda x, i: i * x)), 6) AS weighed,
    round(list_min(embedding::DOUBLE[]), 6) AS least, round(list_max(embedding::DOUBLE[]), 6) AS most FROM embeddings""")
def vector_codec(spark, sf_dir):
    """The decoded vectors; components count with their place."""
    back = embeddings(spark, sf_dir).select("vec_id", V.decode(V.encode(F.col("vec"))).alias("back"))
    weighed = F.aggregate(F.transform("back", lambda x, i: (i + 1) * x), F.lit(0.0), lambda s, x: s + x)
    return back.select("vec_id", F.size("back").cast("long").alias("n"), F.round(weighed, 6).alias("weighed"), F.round(F.array_min("back"), 6).alias("least"), F.round(F.array_max("back"), 6).alias("most"))


@query("vector_normalized", f"WITH {VECTORS_SQL} SELECT vec_id, round(sqrt(list_sum(list_transform(vec, lambda x: x * x))), 6) AS length, round(vec[1] / sqrt(list_sum(list_transform(vec, lambda x: x * x))), 6) AS first FROM vecs")
def vector_normalized(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", F.round(V.norm(F.col("vec")), 6).alias("length"), F.round(V.normalized(F.col("vec"))[0], 6).alias("first"))


@query("similarity_pairs", f"WITH {VECTORS_SQL} SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(a.vec, b.vec), 6) AS similarity FROM vecs a JOIN vecs b ON a.label = b.label AND a.vec_id < b.vec_id")
def similarity_pairs(spark, sf_dir):
    return signals.similarity_pairs(embeddings(spark, sf_dir).withColumnRenamed("vec_id", "row_id"), ["label"])


@query("recent_buckets", f"WITH {REPORTS_SQL} SELECT date_trunc('hour', received_at) AS bucket_start, count(*) AS reports FROM reports GROUP BY 1 ORDER BY 1 DESC LIMIT 12")
def recent_buckets(spark, sf_dir):
    hour = F.date_trunc("hour", "received_at").cast("timestamp_ntz").alias("bucket_start")
    return reports(spark, sf_dir).groupBy(hour).agg(F.count("*").alias("reports")).orderBy(F.col("bucket_start").desc()).limit(12)


@query("maintenance_hour", "SELECT event_id, (hour(ts) + 9) % 24 = 3 AS due FROM events")
def maintenance_hour(spark, sf_dir):
    """Whether an event in UTC falls into the hour from three o'clock in Seoul."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Seoul")
    return table(spark, sf_dir, "events").select("event_id", (F.hour(local) == 3).alias("due"))
