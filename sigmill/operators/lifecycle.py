"""Retention, queues, retries, idempotency and rate limits as pure transitions of tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .signals import detach_reports

#: Retention, retries and their codes.
RETENTION_HOURS = 72
CARD_HOURS = 2
RETRY_SECONDS = 300
FIRST_DELAY, LARGEST_DELAY = 60, 3600
MAX_ATTEMPTS = 5
READY = ("PENDING", "FAILED", "PROCESSING")


def hours(n: int) -> Column:
    return F.make_dt_interval(hours=F.lit(n))


def is_purgeable(purge_at: Column, now: Column) -> Column:
    return purge_at <= now


def is_accessible(expires_at: Column, now: Column) -> Column:
    """A card can be opened before its expiry, not at it."""
    return now < expires_at


def job_ready(jobs: DataFrame, now: Column, active_policy: Column) -> DataFrame:
    mine = F.col("policy_id").isNull() | (F.col("policy_id") == active_policy)
    return jobs.filter(F.col("status").isin(*READY) & (F.col("next_attempt_at") <= now) & mine)


def retry_delay(attempts: Column) -> Column:
    """Seconds to the next attempt: doubling from one minute, at most an hour."""
    doubled = F.lit(FIRST_DELAY) * F.pow(F.lit(2), F.least(attempts - 1, F.lit(6)))
    return F.least(doubled, F.lit(LARGEST_DELAY)).cast("int")


def retry_after(expires_at: Column, now: Column) -> Column:
    gap = (F.unix_micros(expires_at.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 1_000_000
    return F.greatest(F.lit(1), F.ceil(gap)).cast("int")


def failed_job(attempts: Column, error: Column, permanent: Column, now: Column, most: int = MAX_ATTEMPTS) -> Column:
    """struct(status, error_code, next_attempt_at) after a failure."""
    terminal = permanent | (attempts >= most)
    return F.struct(
        F.when(terminal, "DEAD_LETTER").otherwise("FAILED").alias("status"),
        F.when(terminal & ~permanent, "RETRY_EXHAUSTED").otherwise(error).alias("error_code"),
        F.when(terminal, now).otherwise(now + F.make_dt_interval(secs=F.lit(RETRY_SECONDS))).alias("next_attempt_at"),
    )


def deletion_outcome(status: Column, attempts: Column, claimed_attempts: Column, failed: Column, now: Column) -> Column:
    """struct(outcome, status, next_attempt_at, purge_at) of one claimed object deletion; a stale claim changes nothing."""
    stale = (status != "PROCESSING") | (attempts != claimed_attempts)
    later = now + F.make_dt_interval(secs=retry_delay(attempts))
    return F.struct(
        F.when(stale, "SKIPPED").when(failed, "FAILED").otherwise("SUCCEEDED").alias("outcome"),
        F.when(stale, status).when(failed, "RETRY_PENDING").otherwise("COMPLETED").alias("status"),
        F.when(~stale & failed, later).alias("next_attempt_at"),
        F.when(~stale & ~failed, now + hours(RETENTION_HOURS)).alias("purge_at"),
    )


def requeue(reports: DataFrame, jobs: DataFrame, policy: Column, taxonomy: Column, now: Column, limit: int) -> DataFrame:
    """(report_id, action, status, attempt_count): confirmed, retained reports of the taxonomy without a job of the policy.

    A report without job gets one (CREATED); one with another policy's job has it reset (RESET).
    """
    joined = reports.join(jobs.select("report_id", "policy_id", F.lit(True).alias("has_job")), "report_id", "left")
    wanted = F.col("has_job").isNull() | (F.col("policy_id").isNotNull() & (F.col("policy_id") != policy))
    rows = joined.filter((F.col("status") == "CONFIRMED") & (F.col("purge_at") > now) & (F.col("taxonomy_version") == taxonomy) & wanted)
    return rows.orderBy("received_at", "report_id").limit(limit).select(
        "report_id", F.when(F.col("has_job").isNull(), "CREATED").otherwise("RESET").alias("action"), F.lit("PENDING").alias("job_status"), F.lit(0).alias("attempt_count")
    )


def purge(reports: DataFrame, dependents: dict[str, DataFrame], now: Column) -> dict[str, DataFrame]:
    """What stays of the reports and of the tables that hang on them."""
    gone = reports.filter(is_purgeable(F.col("purge_at"), now)).select("report_id")
    kept = {"reports": reports.filter(~is_purgeable(F.col("purge_at"), now))}
    return kept | {name: df.join(gone, "report_id", "left_anti") for name, df in dependents.items()}


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """target with the rows whose key it lacks; of rows with one key the first by all columns enters."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*[c for c in rows.columns if c not in keys]))
    first = rows.withColumn("_place", place).filter("_place = 1").drop("_place")
    return target.unionByName(first.join(target.select(*keys), keys, "left_anti").select(*target.columns))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], latest: str | None = None) -> DataFrame:
    """target with the rows put over those of the same key; of rows repeating a key the one with the largest `latest` enters.

    Ties, and all rows where `latest` is not given, go by the largest of the other columns in their order.
    """
    others = [c for c in target.columns if c not in keys]
    best = F.struct(*([latest] if latest else []), *others)
    last = rows.groupBy(*keys).agg(F.max(best).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others]).select(*target.columns)
    return target.join(rows.select(*keys), keys, "left_anti").select(*target.columns).unionByName(last)


#: When a row of each independent table goes.
PURGED = {
    "idempotency_records": lambda now: F.col("purge_at") <= now,
    "audit_logs": lambda now: F.col("created_at") <= now - hours(RETENTION_HOURS),
    "object_deletion_jobs": lambda now: (F.col("status") == "COMPLETED") & (F.col("purge_at") <= now),
    "agent_tokens": lambda now: F.col("expires_at") <= now,
    "rate_limit_buckets": lambda now: F.col("expires_at") <= now,
    "signal_clusters": lambda now: F.col("purge_at") <= now,
    "signal_audit_events": lambda now: F.col("purge_at") <= now,
}


def purge_all(tables: dict[str, DataFrame], now: Column) -> dict[str, DataFrame]:
    """What stays of reports, of attachments and signal_members that hang on them, and of the tables of PURGED.

    A purged report's attachment enters object_deletion_jobs as PENDING where the key is not there yet, and its purge enters
    audit_logs with the digest of its id. Both are judged by the later tables' own rules.
    """
    gone = tables["reports"].filter(is_purgeable(F.col("purge_at"), now)).select("report_id")
    kept = purge(tables["reports"], {n: tables[n] for n in ("attachments", "signal_members")}, now)
    jobs = tables["object_deletion_jobs"]
    keys = tables["attachments"].join(gone, "report_id", "left_semi").select("object_key").distinct().join(jobs, "object_key", "left_anti")
    fresh = {"status": F.lit("PENDING"), "purge_at": F.lit(None).cast(jobs.schema["purge_at"].dataType), "next_attempt_at": now}
    jobs = jobs.unionByName(keys.select(*[(fresh[c] if c in fresh else F.col(c)).alias(c) for c in jobs.columns]))
    logs = tables["audit_logs"]
    entry = {"action": F.lit("REPORT_RETENTION_PURGED"), "fingerprint": F.sha2(F.col("report_id").cast("string"), 256), "created_at": now}
    logs = logs.unionByName(gone.select(*[entry[c].alias(c) for c in logs.columns]))
    later = tables | {"object_deletion_jobs": jobs, "audit_logs": logs}
    return kept | {name: later[name].filter(~F.coalesce(rule(now), F.lit(False))) for name, rule in PURGED.items()}


def purge_with_signals(tables: dict[str, DataFrame], now: Column, window: int, min_sessions: int, review_sessions: int) -> dict[str, DataFrame]:
    """`purge_all` of tables whose signal_members and signal_clusters hold what evidence needs (operators.signals.detach_reports).

    The signals that lose reports are worked out anew before their own retention is judged.
    """
    gone = tables["reports"].filter(is_purgeable(F.col("purge_at"), now)).select("report_id")
    found = detach_reports(tables["signal_clusters"], tables["signal_members"], gone, now, window, min_sessions, review_sessions)
    return purge_all(tables | {"signal_clusters": found["signals"]}, now)


#: Fixed value: how far back failures of the provider count.
PROVIDER_MINUTES = 15


def operational_metrics(jobs: DataFrame, records: DataFrame, deletions: DataFrame, now: Column) -> DataFrame:
    """One row of six counts.

    jobs: status, attempts, next_attempt_at; records: operation, failure_code, created_at; deletions: status, next_attempt_at.
    """
    due = F.col("next_attempt_at") <= now
    signal = jobs.agg(
        F.count_if(F.col("status").isin(*READY) & due).alias("signal_jobs_ready"),
        F.count_if((F.col("status") == "FAILED") & (F.col("attempts") >= 2)).alias("signal_jobs_repeated_failures"),
        F.count_if(F.col("status") == "DEAD_LETTER").alias("signal_jobs_dead_letter"),
    )
    recent = F.col("created_at") >= now - F.make_dt_interval(mins=F.lit(PROVIDER_MINUTES))
    provider = records.agg(F.count_if((F.col("operation") == "ANALYZE_REPORT") & F.col("failure_code").isNotNull() & recent).alias("provider_failures_last_15m"))
    objects = deletions.agg(
        F.count_if(F.col("status").isin("PENDING", "RETRY_PENDING", "PROCESSING") & due).alias("object_deletion_jobs_ready"),
        F.count_if(F.col("status") == "RETRY_PENDING").alias("object_deletion_jobs_retrying"),
    )
    return signal.crossJoin(provider).crossJoin(objects)  # single rows


def purge_preview(tables: dict[str, DataFrame], now: Column) -> DataFrame:
    """One row with the ten counts of what a purge would take, and the deletions that are due."""
    gone = tables["reports"].filter(is_purgeable(F.col("purge_at"), now))
    counts = {"reports": gone, "attachment_objects": tables["attachments"].join(gone.select("report_id"), "report_id", "left_semi")}
    names = {"object_deletion_jobs": "completed_deletion_jobs", "agent_tokens": "expired_agent_tokens", "rate_limit_buckets": "expired_rate_limit_buckets"}
    counts |= {names.get(n, n): tables[n].filter(rule(now)) for n, rule in PURGED.items()}
    due = F.col("status").isin("PENDING", "RETRY_PENDING", "PROCESSING") & (F.col("next_attempt_at") <= now)
    counts["retry_ready_objects"] = tables["object_deletion_jobs"].filter(due)
    out = None
    for name, rows in counts.items():
        one = rows.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # single rows
    return out


def idempotency(requests: DataFrame) -> DataFrame:
    """(request_id, outcome) for rows (request_id, key, payload_sha256) in order of request_id.

    The first request of a key is NEW; a later one with its payload is a REPLAY, with another a CONFLICT.
    """
    first = F.first("payload_sha256").over(W.partitionBy("key").orderBy("request_id"))
    number = F.row_number().over(W.partitionBy("key").orderBy("request_id"))
    return requests.select(
        "request_id", F.when(number == 1, "NEW").when(F.col("payload_sha256") == first, "REPLAY").otherwise("CONFLICT").alias("outcome")
    )


def fold_window(times, window: float, limit: int, begin: float | None = None, hits: int = 0):
    """Fixed windows that start at a first hit: (allowed, hit number, window end) for each time, and the state after."""
    out = []
    for t in times:
        if begin is None or begin + window <= t:
            begin, hits = t, 0
        hits += 1
        out.append((hits <= limit, hits, begin + window))
    return out, begin, hits


def rate_limit(hits: DataFrame, window: int, limit: int) -> DataFrame:
    """(bucket, hit_id, allowed, hit_number) of rows (bucket, hit_id, at); at in seconds, in order of (at, hit_id).

    The fold streams over sorted partitions, so a bucket of any size passes in bounded memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, begin, count = None, None, 0
        for batch in batches:
            rows = []
            for key, group in batch.groupby("bucket", sort=False):
                if key != bucket:
                    bucket, begin, count = key, None, 0
                found, begin, count = fold_window(group["at"].tolist(), window, limit, begin, count)
                rows.append(group[["bucket", "hit_id"]].assign(allowed=[f[0] for f in found], hit_number=[f[1] for f in found]))
            if rows:
                yield pd.concat(rows)

    dealt = hits.select("bucket", "hit_id", "at").repartition("bucket").sortWithinPartitions("bucket", "at", "hit_id")
    kinds = {f.name: f.dataType.simpleString() for f in hits.schema}
    return dealt.mapInPandas(run, f"bucket {kinds['bucket']}, hit_id {kinds['hit_id']}, allowed boolean, hit_number int")


def alerts(repeated: Column, dead: Column, provider: Column, retrying: Column) -> Column:
    """Names of the counters above zero, in fixed order."""
    pairs = ((repeated, "SIGNAL_JOB_REPEATED_FAILURE"), (dead, "SIGNAL_JOB_DEAD_LETTER"), (provider, "AI_PROVIDER_FAILURE"), (retrying, "OBJECT_DELETION_RETRY"))
    return F.array_compact(F.array(*[F.when(c > 0, F.lit(name)) for c, name in pairs]))


def readiness(guidance: Column, guidance_valid: Column, policy: Column, taxonomy: Column, contract: Column, contract_matches: Column, symbols: Column) -> Column:
    """Names of what is missing or wrong, in fixed order; the arguments say what is present and sound."""
    return F.array_compact(
        F.array(
            F.when(~guidance, "ACTIVE_GUIDANCE_POLICY_MISSING").when(~guidance_valid, "ACTIVE_GUIDANCE_POLICY_INVALID"),
            F.when(~policy, "ACTIVE_SIGNAL_POLICY_MISSING").when(~taxonomy, "SIGNAL_POLICY_TAXONOMY_MISMATCH"),
            F.when(policy & ~contract, "SIGNAL_EMBEDDING_CONTRACT_MISSING").when(policy & ~contract_matches, "SIGNAL_POLICY_CONTRACT_MISMATCH"),
            F.when(~symbols, "ACTIVE_SYMBOL_MASTER_MISSING"),
        )
    )


def latest_policy(events: DataFrame) -> DataFrame:
    """(policy_id, is_active): folds approvals (at, policy_id); the last approved one is the only active."""
    last = events.groupBy("policy_id").agg(F.max("at").alias("at"))
    newest = last.agg(F.max(F.struct("at", "policy_id"))["policy_id"].alias("newest"))  # a single row
    return last.crossJoin(F.broadcast(newest)).select("policy_id", (F.col("policy_id") == F.col("newest")).alias("is_active"))
