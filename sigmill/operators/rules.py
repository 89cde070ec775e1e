"""Reviewer decisions: relevance, verification, locks, field comparison and work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gates import EXCLUDED_TYPES

#: The order of severity and the compared fields.
PRIORITY = ("MATCHED", "NEEDS_CONFIRMATION", "IMPORTANT")
FIELDS = ("action", "symbol_name", "symbol_code", "quantity", "order_type", "price_krw", "submission_status")


def relevance(issue: Column, signal_issue: Column, similarity: Column, occurred: Column, begin: Column, end: Column, threshold: Column) -> Column:
    """struct(status, reason): the first gate that fails decides."""

    def result(status: str, reason: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))

    outside = (occurred < begin) | F.coalesce(occurred > end, F.lit(False))
    return (
        F.when(issue.isin(*EXCLUDED_TYPES) | signal_issue.isin(*EXCLUDED_TYPES), result("NOT_RELATED", "INELIGIBLE_ISSUE_TYPE"))
        .when(issue != signal_issue, result("NOT_RELATED", "ISSUE_TYPE_MISMATCH"))
        .when(similarity < threshold, result("NOT_RELATED", "SIMILARITY_BELOW_THRESHOLD"))
        .when(occurred.isNull(), result("NEEDS_CONFIRMATION", "OCCURRED_AT_MISSING"))
        .when(outside, result("NOT_RELATED", "OUTSIDE_SIGNAL_WINDOW"))
        .otherwise(result("RELATED", "ALL_GATES_PASSED"))
    )


def verification(relevance_status: Column, decision: Column) -> Column:
    """struct(status, final_related, reason, requires_reconfirmation) of an agent's decision."""
    related = decision == "RELATED"

    def result(status: str, final: Column, reason: str, again: bool) -> Column:
        return F.struct(
            F.lit(status).alias("status"), final.alias("final_related"), F.lit(reason).alias("reason"), F.lit(again).alias("requires_reconfirmation")
        )

    none = F.lit(None).cast("boolean")
    return (
        F.when(decision == "UNCONFIRMED", result("NEEDS_CONFIRMATION", none, "AGENT_CONFIRMATION_MISSING", True))
        .when(relevance_status == "NEEDS_CONFIRMATION", result("MATCHED", related, "AGENT_RESOLVED_AI_UNCERTAINTY", False))
        .when((relevance_status == "RELATED") == related, result("MATCHED", related, "AI_AND_AGENT_AGREE", False))
        .otherwise(result("IMPORTANT", none, "AI_AND_AGENT_DISAGREE", True))
    )


def lock_decision(status: Column, again: Column, final: Column, locked_final: Column, same_policy: Column) -> Column:
    """struct(decision, reason); locked_final is null where nothing is locked yet."""

    def result(decision: str, reason: str) -> Column:
        return F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))

    return (
        F.when(status != "MATCHED", result("BLOCK", "VERIFICATION_NOT_MATCHED"))
        .when(again, result("BLOCK", "RECONFIRMATION_REQUIRED"))
        .when(final.isNull(), result("BLOCK", "FINAL_RELEVANCE_MISSING"))
        .when(locked_final.isNull(), result("ALLOW", "VERIFIED_RESULT"))
        .when((locked_final == final) & same_policy, result("IDEMPOTENT_REPLAY", "SAME_RESULT_ALREADY_LOCKED"))
        .otherwise(result("CONFLICT", "LOCKED_RESULT_DIFFERS"))
    )


def field_status(customer: Column, agent: Column) -> Column:
    a, b = customer.cast("string"), agent.cast("string")
    unknown = a.isNull() | b.isNull() | (a == "UNKNOWN") | (b == "UNKNOWN")
    return F.when(unknown, "NEEDS_CONFIRMATION").when(a != b, "IMPORTANT").otherwise("MATCHED")


def compare_fields(pairs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, customer_value, agent_value, status): one row for each of the customer_x and agent_x columns."""
    entries = [
        F.struct(
            F.lit(f).alias("field"),
            F.col(f"customer_{f}").cast("string").alias("customer_value"),
            F.col(f"agent_{f}").cast("string").alias("agent_value"),
            field_status(F.col(f"customer_{f}"), F.col(f"agent_{f}")).alias("status"),
        )
        for f in fields
    ]
    return pairs.select(key, F.inline(F.array(*entries)))


def overall(pairs: DataFrame, key: str, fields: list[str], history_checked: str = "order_history_checked") -> DataFrame:
    """(key, status, mismatch_fields): the severest status, unchecked history counting as one to confirm; no shuffle."""
    statuses = [field_status(F.col(f"customer_{f}"), F.col(f"agent_{f}")) for f in fields]
    rank = F.greatest(
        *[F.coalesce(*[F.when(s == p, F.lit(i)) for i, p in enumerate(PRIORITY)]) for s in statuses],
        F.when(F.col(history_checked), 0).otherwise(1),
    )
    mismatch = F.array_compact(F.array(*[F.when(s == "IMPORTANT", F.lit(f)) for s, f in zip(statuses, fields, strict=True)]))
    return pairs.select(key, F.element_at(F.array(*map(F.lit, PRIORITY)), rank + 1).alias("status"), mismatch.alias("mismatch_fields"))


def latest(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, value) of the last row of each key; one shuffle of partial maxima."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def card_list(cards: DataFrame, verifications: DataFrame, now: Column, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of retained, confirmed, issued cards with their latest verification.

    cards: card_id, received_at, status, purge_at, expires_at, reference; verifications: card_id, verification_status and the order columns at, id.
    """
    last = latest(verifications, "card_id", "verification_status", ["at", "id"])
    shown = cards.filter((F.col("purge_at") > now) & (F.col("status") == "CONFIRMED") & F.col("expires_at").isNotNull() & F.col("reference").isNotNull())
    shown = shown.join(last, "card_id", "left").select(
        "card_id",
        "received_at",
        "expires_at",
        (F.col("expires_at") <= now).alias("expired"),
        (F.col("expires_at") > now).alias("can_open"),
        F.when(F.col("verification_status").isNull(), "OPEN").otherwise("VERIFIED").alias("consultation_status"),
        "verification_status",
    )
    return shown.orderBy(F.col("received_at").desc(), F.col("card_id").desc()).offset(offset).limit(limit)


def related_state(members: DataFrame, signals: DataFrame) -> DataFrame:
    """(report_id, state): ACTIVE with a detected or reviewed signal, else CANDIDATE with a candidate, else NONE."""
    state = members.join(signals.select("signal_id", "status"), "signal_id", "left")
    active = F.max(F.col("status").isin("SIGNAL_DETECTED", "UNDER_REVIEW"))
    waiting = F.max(F.col("status") == "CANDIDATE")
    return state.groupBy("report_id").agg(F.when(active, "ACTIVE").when(waiting, "CANDIDATE").otherwise("NONE").alias("state"))
