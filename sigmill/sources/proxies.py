"""The report tables as projections of the generic test tables (events, embeddings, orders, lineitem, part)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Six hours: windows of the sparse test events.
WINDOW_SECONDS = 21_600
MIN_SESSIONS = 5
REVIEW_SESSIONS = 10
ISSUE_TYPES = {
    "error": "ORDER_SUBMISSION_FAILURE",
    "click": "LOGIN_ACCESS_FAILURE",
    "purchase": "ORDER_RESULT_UNCONFIRMED",
    "view": "BALANCE_INQUIRY_ERROR",
    "signup": "UNKNOWN",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with their symptom: report_id, session_id, received_at, purge_at, symptom, issue_type, k, ..."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    issue = F.coalesce(*[F.when(F.col("event_type") == a, F.lit(b)) for a, b in ISSUE_TYPES.items()])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("report_id"),
        F.col("user_id").alias("session_id"),
        F.col("ts").alias("received_at"),
        (F.col("ts") + F.expr("INTERVAL 72 HOURS")).alias("purge_at"),
        F.col("event_type").alias("symptom"),
        issue.alias("issue_type"),
        k.alias("k"),
        F.when(k % 3 != 0, F.concat(F.lit("E"), (k % 4).cast("string"))).alias("error_code"),
        F.when(k % 3 == 0, "SUBMITTED").when(k % 3 == 1, "NOT_SUBMITTED").otherwise("UNKNOWN").alias("submission_status"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible reports with a pseudo-signal for each issue type and day."""
    day = F.date_format("received_at", "yyyy-MM-dd")
    rows = reports(spark, sf_dir).filter("issue_type <> 'UNKNOWN'")
    return rows.withColumn("signal_id", F.concat_ws("|", "issue_type", day))


#: The same projections for the comparison SQL.
REPORTS_SQL = """reports AS (
  SELECT event_id AS report_id, user_id AS session_id, ts AS received_at, ts + INTERVAL 72 HOUR AS purge_at, event_type AS symptom,
         CASE event_type WHEN 'error' THEN 'ORDER_SUBMISSION_FAILURE' WHEN 'click' THEN 'LOGIN_ACCESS_FAILURE'
              WHEN 'purchase' THEN 'ORDER_RESULT_UNCONFIRMED' WHEN 'view' THEN 'BALANCE_INQUIRY_ERROR' WHEN 'signup' THEN 'UNKNOWN' END AS issue_type,
         k, CASE WHEN k % 3 <> 0 THEN 'E' || (k % 4) END AS error_code,
         CASE k % 3 WHEN 0 THEN 'SUBMITTED' WHEN 1 THEN 'NOT_SUBMITTED' ELSE 'UNKNOWN' END AS submission_status
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)
)"""
MEMBERS_SQL = REPORTS_SQL + """, members AS (
  SELECT *, issue_type || '|' || strftime(received_at, '%Y-%m-%d') AS signal_id FROM reports WHERE issue_type <> 'UNKNOWN'
)"""
