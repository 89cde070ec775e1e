"""The row rules of the report store's tables: formats, values, ranges, implications and the columns that a state needs.

A rule is a condition in SQL that both Spark and a test database read (MATCHES stands for their regular-expression
function); a row breaks it where the condition is false, not where it is null. Each rule also names sample values of its
columns, sound and broken ones, from which tests and the registered query make tables.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gates import violations

#: (name, condition, samples as SQL literals by column)
Rule = tuple[str, str, dict[str, tuple[str, ...]]]

_DIGEST = "unhex('" + "ab" * 32 + "')"
_TIMES = ("TIMESTAMP '2026-01-01 00:00:00'", "TIMESTAMP '2026-01-02 00:00:00'", "NULL")


def _text(value: str) -> str:
    return f"'{value}'"


def value(column: str, *allowed: str, optional: bool = False, name: str | None = None) -> Rule:
    condition = f"{column} IN ({', '.join(map(_text, allowed))})"
    return name or f"{column}_value", f"{column} IS NULL OR {condition}" if optional else condition, {column: (*map(_text, allowed), "'OTHER'", "NULL")}


def matches(column: str, pattern: str, good: str, bad: str, optional: bool = False, name: str | None = None) -> Rule:
    condition = f"MATCHES({column}, '{pattern}')"
    return name or f"{column}_format", f"{column} IS NULL OR {condition}" if optional else condition, {column: (_text(good), _text(bad), "NULL")}


def hex64(column: str, optional: bool = False) -> Rule:
    return matches(column, "^[0-9a-f]{64}$", "0123456789abcdef" * 4, "0123456789ABCDEF" * 4, optional, f"{column}_lower_hex")


def digest(column: str, optional: bool = False) -> Rule:
    condition = f"octet_length({column}) = 32"
    return f"{column}_length", f"{column} IS NULL OR {condition}" if optional else condition, {column: (_DIGEST, "unhex('abcd')", "NULL")}


def filled(column: str) -> Rule:
    return f"{column}_not_empty", f"length(trim({column})) > 0", {column: ("'x'", "'  '", "''", "NULL")}


def sized(column: str, least: int, most: int, optional: bool = False) -> Rule:
    condition = f"length(trim({column})) BETWEEN {least} AND {most}"
    return f"{column}_length", f"{column} IS NULL OR {condition}" if optional else condition, {column: ("'x'", f"'{'x' * (most + 1)}'", "' '", "NULL")}


def above(column: str, least: int, optional: bool = False) -> Rule:
    name = f"{column}_{'positive' if least else 'nonnegative'}"
    return name, f"{column} IS NULL OR {column} >= {least}" if optional else f"{column} >= {least}", {column: ("1", "0", "-1", "7", "NULL")}


def between(column: str, low: float, high: float, *samples: str) -> Rule:
    return f"{column}_range", f"{column} BETWEEN {low} AND {high}", {column: (*samples, "NULL")}


def ordered(name: str, condition: str, *columns: str) -> Rule:
    return name, condition, {c: _TIMES for c in columns}


def _all(columns: Iterable[str], kind: str) -> str:
    return " AND ".join(f"{c} IS {kind}" for c in columns)


def together(name: str, *columns: str) -> Rule:
    """All of the columns are set, or none."""
    return name, f"({_all(columns, 'NULL')}) OR ({_all(columns, 'NOT NULL')})", {c: ("'set'", "NULL") for c in columns}


def when(name: str, column: str, states: str, given: Iterable[str] = (), empty: Iterable[str] = ()) -> Rule:
    """In the state, `given` are set and `empty` are not."""
    given, empty = tuple(given), tuple(empty)
    needs = " AND ".join(x for x in (_all(given, "NOT NULL"), _all(empty, "NULL")) if x)
    return name, f"{column} <> '{states}' OR ({needs})", {c: ("'set'", "NULL") for c in (*given, *empty)}


_SUBMISSION = ("CUSTOMER_REPORTED_SUBMITTED", "CUSTOMER_REPORTED_NOT_SUBMITTED", "UNKNOWN")
_SIGNAL = ("CANDIDATE", "SIGNAL_DETECTED", "UNDER_REVIEW", "CLOSED")
_ORDER = [
    value("action", "BUY", "SELL", "UNKNOWN"),
    matches("symbol_code", "^[0-9A-Z]{6}$", "00593K", "5930", True),
    above("quantity", 1, True),
    value("order_type", "LIMIT", "MARKET", "UNKNOWN"),
    above("price_krw", 1, True),
    ("market_order_without_price", "order_type <> 'MARKET' OR price_krw IS NULL", {}),
    ("limit_order_requires_price", "order_type <> 'LIMIT' OR price_krw IS NOT NULL", {}),
]
_KEY = matches("object_key", "^[A-Za-z0-9_-]{43}$", "k" * 43, "k" * 42)

#: The rules of each table.
RULES: dict[str, list[Rule]] = {
    "policy_snapshots": [hex64("content_sha256")],
    "symbol_master_versions": [
        filled("version"),
        hex64("source_sha256"),
        value("source_encoding", "UTF-8-SIG", "CP949", "API-JSON"),
        value("source_kind", "KRX_CSV", "LISTED_API_RECONCILIATION"),
        (
            "source_lineage",
            "(source_kind = 'KRX_CSV' AND parent_version_id IS NULL AND baseline_version_id IS NULL AND source_encoding IN ('UTF-8-SIG', 'CP949')) OR "
            "(source_kind = 'LISTED_API_RECONCILIATION' AND parent_version_id IS NOT NULL AND baseline_version_id IS NOT NULL AND source_encoding = 'API-JSON')",
            {"parent_version_id": ("'v'", "NULL"), "baseline_version_id": ("'v'", "NULL")},
        ),
        above("row_count", 1),
    ],
    "symbols": [
        matches("code", "^[0-9A-Z]{6}$", "005930", "A05930x"),
        filled("name_ko"),
        value("market", "KOSPI", "KOSDAQ"),
        value("source_market", "KOSPI", "KOSDAQ", "KOSDAQ GLOBAL"),
        value("stock_type", "보통주", name="stock_type_common"),
        ordered(
            "listed_api_observation_order",
            "listed_api_missing_since IS NULL OR listed_api_last_seen_on IS NULL OR listed_api_missing_since > listed_api_last_seen_on",
            "listed_api_missing_since", "listed_api_last_seen_on",
        ),
    ],
    "reports": [
        digest("session_digest"),
        filled("masked_text"),
        hex64("request_payload_sha256"),
        value("status", "ANALYSIS_PENDING", "AWAITING_CONFIRMATION", "CONFIRMED", "ANALYSIS_FAILED"),
        ("confirmed_at_matches_status", "(status = 'CONFIRMED') = (confirmed_at IS NOT NULL)", {"confirmed_at": _TIMES}),
    ],
    "report_analyses": [
        above("version", 1),
        value("status", "PENDING", "SUCCEEDED", "FAILED"),
        when("pending_payload", "status", "PENDING", (), ("technical_candidate", "consultation_candidate", "safe_error_code", "completed_at")),
        when("succeeded_payload", "status", "SUCCEEDED", ("technical_candidate", "consultation_candidate", "completed_at"), ("safe_error_code",)),
        when("failed_payload", "status", "FAILED", ("safe_error_code", "completed_at"), ("technical_candidate", "consultation_candidate")),
    ],
    "attachments": [
        _KEY,
        value("content_type", "image/png", "image/jpeg", "image/webp"),
        between("byte_size", 1, 5242880, "1", "0", "5242880", "5242881"),
        (
            "dimensions_range",
            "width BETWEEN 1 AND 4096 AND height BETWEEN 1 AND 4096 AND width * height <= 16000000",
            {"width": ("1", "4000", "4096", "4097", "NULL"), "height": ("0", "4000", "4096", "NULL")},
        ),
        hex64("content_sha256"),
    ],
    "technical_symptoms": [
        value("channel", "MABLE"),
        value("feature_area", "DOMESTIC_STOCK_ORDER"),
        matches("issue_type", "^[A-Z][A-Z0-9_]{0,63}$", "LOGIN_1", "login"),
        sized("symptom", 1, 500, True),
        value("submission_status", *_SUBMISSION),
        matches("error_code", "^[A-Za-z0-9._-]{1,64}$", "E-1.0", "E 1", True),
    ],
    "consultation_cards": [
        *_ORDER,
        digest("reference_digest", True),
        hex64("confirmation_payload_sha256", True),
        together("reference_metadata_complete", "reference_digest", "expires_at", "confirmation_request_id", "confirmation_payload_sha256"),
    ],
    "agent_accounts": [matches("employee_id", "^[A-Z0-9_-]{4,32}$", "AG_01", "ag1"), sized("agent_label", 1, 80), value("role", "AGENT", "OPERATOR")],
    "agent_access_tokens": [digest("token_digest"), ordered("expiry_after_creation", "expires_at > created_at", "expires_at", "created_at")],
    "agent_verifications": [*_ORDER, value("submission_status", *_SUBMISSION), value("overall_status", "MATCHED", "NEEDS_CONFIRMATION", "IMPORTANT")],
    "clustering_policies": [
        value("status", "EXPERIMENTAL", "APPROVED", "RETIRED"),
        above("window_seconds", 1),
        above("min_unique_sessions", 1),
        ("review_threshold_not_below_minimum", "review_priority_threshold >= min_unique_sessions", {"review_priority_threshold": ("1", "0", "9", "NULL")}),
        ("similarity_threshold_range", "similarity_threshold > 0 AND similarity_threshold <= 1", {"similarity_threshold": ("0.56", "0", "1", "1.5", "NULL")}),
        above("embedding_dimension", 1),
        value("normalization", "L2", "NONE"),
        value("distance_metric", "COSINE", name="distance_metric_cosine"),
        value("linkage_method", "SINGLE_MAX", "AVERAGE"),
        value("representative_method", "NONE", "MEDOID"),
        value("structured_rules_version", "hard-gate.v1"),
        when("approval_metadata", "status", "APPROVED", ("approved_by", "approved_at", "approval_evidence_sha256")),
        hex64("approval_evidence_sha256", True),
    ],
    "technical_embeddings": [
        above("embedding_dimension", 1),
        value("normalization", "L2", "NONE"),
        value("distance_metric", "COSINE", name="distance_metric_cosine"),
        ("embedding_dimension_matches_vector", "vector_size = embedding_dimension", {"vector_size": ("1", "7", "NULL")}),
    ],
    "signal_processing_jobs": [
        value("status", "PENDING", "PROCESSING", "FAILED", "DEAD_LETTER", "COMPLETED"),
        above("attempt_count", 0),
        value("safe_error_code", "EMBEDDING_UNAVAILABLE", "INVALID_EMBEDDING", "POLICY_MISMATCH", "EMBEDDING_INPUT_UNAVAILABLE", "RETRY_EXHAUSTED", optional=True),
    ],
    "signal_clusters": [
        value("status", *_SIGNAL),
        value("closure_reason", "WINDOW_EXPIRED", "FALSE_POSITIVE", "MERGED", "OFFICIAL_INCIDENT_RESOLVED", "EVIDENCE_RECALCULATED", optional=True),
        (
            "closed_metadata",
            "(status = 'CLOSED' AND closure_reason IS NOT NULL AND closed_at IS NOT NULL) OR (status <> 'CLOSED' AND closure_reason IS NULL AND closed_at IS NULL)",
            {"closed_at": _TIMES},
        ),
        above("raw_report_count", 0),
        above("reporting_unique_sessions", 0),
        ("unique_sessions_not_above_raw_count", "reporting_unique_sessions <= raw_report_count", {}),
        together("official_notice_metadata", "official_notice_url", "official_notice_linked_at", "official_notice_linked_by"),
    ],
    "signal_members": [between("similarity_at_join", -1, 1, "0.5", "-1", "1", "1.01")],
    "agent_signal_verifications": [
        value("relevance_status", "RELATED", "NEEDS_CONFIRMATION", "NOT_RELATED"),
        value("agent_decision", "RELATED", "NOT_RELATED", "UNCONFIRMED"),
        value("verification_status", "MATCHED", "NEEDS_CONFIRMATION", "IMPORTANT"),
        value("lock_decision", "ALLOW", "BLOCK", "IDEMPOTENT_REPLAY", "CONFLICT"),
    ],
    "signal_audit_events": [
        matches("action", "^[A-Z][A-Z0-9_]{0,63}$", "SIGNAL_MERGED", "merged"),
        value("before_status", *_SIGNAL, optional=True),
        value("after_status", *_SIGNAL, optional=True),
    ],
    "rate_limit_buckets": [
        value("scope", "AGENT_LOGIN_FAILURE", "AGENT_CARD_LOOKUP", "SIGNAL_DASHBOARD", "REPORT_ANALYZE"),
        digest("principal_fingerprint"),
        digest("client_fingerprint"),
        above("request_count", 1),
        ordered("expiry_after_window_start", "expires_at > window_started_at", "expires_at", "window_started_at"),
    ],
    "idempotency_records": [
        digest("principal_digest"),
        hex64("payload_sha256"),
        between("response_status", 200, 599, "200", "599", "199", "600"),
        value("processing_status", "COMPLETED"),
        value("safe_failure_code", "TIMEOUT", "INVALID_SCHEMA", "PROVIDER_UNAVAILABLE", optional=True),
    ],
    "audit_logs": [hex64("resource_fingerprint"), value("outcome", "SUCCESS", "FAILURE", "RATE_LIMITED", "REPLAY", "CONFLICT")],
    "object_deletion_jobs": [
        _KEY,
        value("status", "PENDING", "PROCESSING", "RETRY_PENDING", "COMPLETED"),
        above("attempt_count", 0),
        value("safe_error_code", "STORAGE_UNAVAILABLE", optional=True),
        (
            "state_metadata",
            "CASE status WHEN 'PENDING' THEN attempt_count = 0 AND safe_error_code IS NULL AND next_attempt_at IS NOT NULL AND completed_at IS NULL AND purge_at IS NULL "
            "WHEN 'PROCESSING' THEN attempt_count > 0 AND safe_error_code IS NULL AND next_attempt_at IS NOT NULL AND completed_at IS NULL AND purge_at IS NULL "
            "WHEN 'RETRY_PENDING' THEN attempt_count > 0 AND safe_error_code IS NOT NULL AND next_attempt_at IS NOT NULL AND completed_at IS NULL AND purge_at IS NULL "
            "WHEN 'COMPLETED' THEN attempt_count > 0 AND safe_error_code IS NULL AND next_attempt_at IS NULL AND completed_at IS NOT NULL AND purge_at IS NOT NULL ELSE false END",
            {c: _TIMES for c in ("next_attempt_at", "completed_at", "purge_at")},
        ),
    ],
}

#: The rules of request and response fields that are not table rules.
CONTRACTS: dict[str, list[Rule]] = {
    "candidate_fields": [
        value("status", "CONFIRMED_FROM_TEXT", "NEEDS_CONFIRMATION", "UNKNOWN"),
        when("confirmed_has_value_and_quote", "status", "CONFIRMED_FROM_TEXT", ("field_value", "quote")),
        when("unknown_has_neither", "status", "UNKNOWN", (), ("field_value", "quote")),
        when("to_confirm_has_quote", "status", "NEEDS_CONFIRMATION", ("quote",)),
        ("confirmed_time_is_named", "is_time = 0 OR status <> 'CONFIRMED_FROM_TEXT' OR quote_names_time = 1", {"is_time": ("0", "1"), "quote_names_time": ("0", "1")}),
    ],
    "orders": [_ORDER[3], _ORDER[4], _ORDER[5], _ORDER[6]],
    "baselines": [
        value("baseline_status", "AVAILABLE", "ZERO_BASELINE", "INSUFFICIENT_HISTORY"),
        ("ratio_with_status", "(baseline_status = 'AVAILABLE') = (baseline_ratio IS NOT NULL)", {"baseline_ratio": ("1.5", "NULL")}),
    ],
    "selectors": [
        ("exactly_one_selector", "(card_id IS NULL) <> (reference IS NULL)", {"card_id": ("'c'", "NULL"), "reference": ("'r'", "NULL")}),
    ],
    "merge_requests": [("different_signals", "source_id <> target_id", {"source_id": ("'a'", "'b'"), "target_id": ("'a'", "'c'")})],
    "split_requests": [("report_ids_unique", "ids = distinct_ids AND ids > 0", {"ids": ("1", "2", "0"), "distinct_ids": ("1", "2", "0")})],
    "instants": [("instant_has_zone", "MATCHES(instant, '(Z|[+-][0-9]{2}:[0-9]{2})$')", {"instant": ("'2026-01-01T00:00:00Z'", "'2026-01-01T00:00:00'", "'2026-01-01T00:00:00+09:00'")})],
}


def condition(rule: Rule, function: str = "regexp_like") -> str:
    return rule[1].replace("MATCHES(", f"{function}(")


def check(rows: DataFrame, name: str, rules: list[Rule]) -> DataFrame:
    """(table_name, rule, violations) of one table."""
    return violations(rows, name, {rule[0]: F.expr(condition(rule)) for rule in rules})


def sample_sql(rules: list[Rule], key: str) -> dict[str, str]:
    """For each column of the rules, SQL that takes one of its samples by `key`, mixed by a multiplication of its own."""
    samples: dict[str, tuple[str, ...]] = {}
    for _, _, columns in rules:
        for column, values in columns.items():
            samples.setdefault(column, values)
    out = {}
    for i, (column, values) in enumerate(samples.items()):
        cases = " ".join(f"WHEN {j} THEN {v}" for j, v in enumerate(values) if v != "NULL")
        out[column] = f"CASE ({key} * {104_729 + 7_919 * i * i} % {1_299_709 + 14 * i}) % {len(values)} {cases} END"
    return out


def samples(rows: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    columns: list[Column] = [F.expr(sql).alias(column) for column, sql in sample_sql(rules, key).items()]
    return rows.select(*columns)
