"""Scenarios with known outcome for evidence, lists, merges and rules."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from sigmill.operators import gates, rules, signals

T0 = dt.datetime(2026, 8, 29, 3, 0, 0)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def members(spark, rows, signal="S"):
    data = [(signal, i, s, at(t), at(t) + dt.timedelta(hours=72)) for i, (s, t) in enumerate(rows, 1)]
    return spark.createDataFrame(data, "signal_id string, report_id long, session_id string, received_at timestamp_ntz, purge_at timestamp_ntz")


def stamp(seconds):
    return F.lit(at(seconds)).cast("timestamp_ntz")


def test_baseline_available(spark):
    m = members(spark, [("a", 0), ("b", 600), ("c", 1200)])
    e = signals.evidence(m, 600, 1, 10)
    r = e.first()
    assert (r.raw_report_count, r.unique_sessions, r.status) == (2, 2, "SIGNAL_DETECTED")
    b = signals.baseline(m, e, 600, stamp(-7200))
    assert (b.first().baseline_status, b.first().baseline_ratio) == ("AVAILABLE", 2.0)
    assert signals.hourly_volume(m, e, 600).agg(F.sum("raw_report_count")).first()[0] == 2
    assert tuple(signals.dashboard_baseline(b).first()) == ("AVAILABLE", 2.0)
    assert signals.baseline(m, e, 600, stamp(1)).first().baseline_status == "INSUFFICIENT_HISTORY"


def test_zero_baseline(spark):
    m = members(spark, [("c", 1200)])
    b = signals.baseline(m, signals.evidence(m, 600, 1, 10), 600, stamp(-7200))
    assert tuple(b.first())[-2:] == ("ZERO_BASELINE", None)
    assert tuple(signals.dashboard_baseline(b.filter("false")).first()) == ("INSUFFICIENT_HISTORY", None)


@pytest.mark.parametrize(("status", "now", "visible"), [("SIGNAL_DETECTED", 600, True), ("SIGNAL_DETECTED", 601, False), ("UNDER_REVIEW", 99_999, True), ("CANDIDATE", 0, False)])
def test_visibility(spark, status, now, visible):
    row = spark.range(1).select(gates.is_public(F.lit(status), stamp(0), F.lit(600), stamp(now)).alias("v")).first()
    assert row.v is visible


def test_operator_list_keeps_expired_signals(spark):
    e = signals.evidence(members(spark, [("a", 0)]), 600, 1, 10).withColumn("representative_id", F.lit(None).cast("long"))
    symptoms = spark.createDataFrame([(1, "x")], "representative_id long, representative_text string")
    r = signals.operator_signals(e, symptoms, stamp(601), 600).first()
    assert not r.public_visible and r.window_expires_at == at(600) and r.representative_text is None
    assert signals.dashboard_items(e, stamp(601), 600).count() == 0


def test_deletion_closes(spark):
    m = members(spark, [("a", 0), ("b", 1)])
    r = signals.detach(m, m.filter("report_id = 1"), 600, 2, 10).first()
    assert (r.status, r.closure_reason, r.raw_report_count, r.unique_sessions) == ("CLOSED", "EVIDENCE_RECALCULATED", 1, 1)


def test_merge_then_split(spark):
    both = members(spark, [("a", 0)]).unionByName(members(spark, [("b", 1)], "T").withColumn("report_id", F.lit(2).cast("long")))
    merged = signals.merge(both, "T", "S")
    assert {r.signal_id for r in merged.collect()} == {"S"} and merged.count() == 2
    parted = signals.split(merged, merged.filter("report_id = 2"), "S", "N")
    assert sorted(r.signal_id for r in parted.collect()) == ["N", "S"]
    assert signals.merge(both.withColumn("report_id", F.lit(1).cast("long")), "T", "S").count() == 1


def test_medoids(spark):
    rows = [("A", 1, "x", [1.0, 0.0]), ("A", 2, "y", [1.0, 1.0]), ("A", 3, "z", [0.0, 1.0]), ("B", 4, "b", [1.0, 0.0]), ("B", 5, "c", [1.0, 0.0]), ("C", 6, "c", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "signal_id string, member_id long, text string, vec array<double>")
    for alone in (True, False):
        assert {r.signal_id: r.member_id for r in signals.medoid(df.drop("text"), alone, 9).collect()} == {"A": 2, "B": 4, "C": 6}
    texts = signals.text_medoid(df.select(F.col("signal_id").alias("group_id"), "text", "vec"), 9)
    assert {r.group_id: r.text for r in texts.collect()} == {"A": "y", "B": "c", "C": "c"}


@pytest.mark.parametrize(
    ("issue", "other", "similarity", "when", "expected"),
    [
        ("UNKNOWN", "A", 1.0, 5, ("NOT_RELATED", "INELIGIBLE_ISSUE_TYPE")),
        ("A", "B", 1.0, 5, ("NOT_RELATED", "ISSUE_TYPE_MISMATCH")),
        ("A", "A", 0.5, 5, ("NOT_RELATED", "SIMILARITY_BELOW_THRESHOLD")),
        ("A", "A", 0.56, None, ("NEEDS_CONFIRMATION", "OCCURRED_AT_MISSING")),
        ("A", "A", 0.9, -1, ("NOT_RELATED", "OUTSIDE_SIGNAL_WINDOW")),
        ("A", "A", 0.9, 11, ("NOT_RELATED", "OUTSIDE_SIGNAL_WINDOW")),
        ("A", "A", 0.9, 0, ("RELATED", "ALL_GATES_PASSED")),
        ("A", "A", 0.9, 10, ("RELATED", "ALL_GATES_PASSED")),
    ],
)
def test_relevance(spark, issue, other, similarity, when, expected):
    occurred = F.lit(None).cast("timestamp_ntz") if when is None else stamp(when)
    r = rules.relevance(F.lit(issue), F.lit(other), F.lit(similarity), occurred, stamp(0), stamp(10), F.lit(0.56))
    assert tuple(spark.range(1).select(r.alias("r")).first().r) == expected


def test_verification_and_locks(spark):
    none = F.lit(None).cast("boolean")
    cases = {
        ("RELATED", "RELATED"): ("MATCHED", True), ("NOT_RELATED", "NOT_RELATED"): ("MATCHED", False), ("RELATED", "NOT_RELATED"): ("IMPORTANT", None),
        ("NEEDS_CONFIRMATION", "RELATED"): ("MATCHED", True), ("RELATED", "UNCONFIRMED"): ("NEEDS_CONFIRMATION", None),
    }
    for (a, b), want in cases.items():
        v = spark.range(1).select(rules.verification(F.lit(a), F.lit(b)).alias("v")).first().v
        assert (v.status, v.final_related) == want and v.requires_reconfirmation == (want[0] != "MATCHED")
    locks = {
        ("IMPORTANT", True, True, None, True): "BLOCK", ("MATCHED", True, True, None, True): "BLOCK", ("MATCHED", False, None, None, True): "BLOCK",
        ("MATCHED", False, True, None, True): "ALLOW", ("MATCHED", False, True, True, True): "IDEMPOTENT_REPLAY", ("MATCHED", False, True, False, True): "CONFLICT",
        ("MATCHED", False, True, True, False): "CONFLICT",
    }
    for (status, again, final, locked, same), want in locks.items():
        d = rules.lock_decision(F.lit(status), F.lit(again), none if final is None else F.lit(final), none if locked is None else F.lit(locked), F.lit(same))
        assert spark.range(1).select(d.alias("d")).first().d.decision == want


def test_fields(spark):
    df = spark.createDataFrame([(1, "BUY", "SELL", 5, 5, True), (2, "BUY", "BUY", 5, None, True), (3, "BUY", "BUY", 5, 5, False), (4, "BUY", "BUY", 5, 5, True)],
                               "id int, customer_action string, agent_action string, customer_quantity int, agent_quantity int, order_history_checked boolean")
    out = {r.id: (r.status, r.mismatch_fields) for r in rules.overall(df, "id", ["action", "quantity"]).collect()}
    assert out == {1: ("IMPORTANT", ["action"]), 2: ("NEEDS_CONFIRMATION", []), 3: ("NEEDS_CONFIRMATION", []), 4: ("MATCHED", [])}
    assert rules.compare_fields(df, "id", ["action", "quantity"]).count() == 8


def test_cards(spark):
    rows = [(1, at(0), "CONFIRMED", at(9000), at(500), "r"), (2, at(1), "CONFIRMED", at(9000), at(100), "r"), (3, at(2), "CONFIRMED", at(100), at(500), "r")]
    cards = spark.createDataFrame(rows, "card_id long, received_at timestamp_ntz, status string, purge_at timestamp_ntz, expires_at timestamp_ntz, reference string")
    checks = spark.createDataFrame([(1, "MATCHED", 1, 1), (1, "IMPORTANT", 2, 1)], "card_id long, verification_status string, at long, id long")
    out = [(r.card_id, r.expired, r.can_open, r.consultation_status, r.verification_status) for r in rules.card_list(cards, checks, stamp(100)).collect()]
    assert out == [(2, True, False, "OPEN", None), (1, False, True, "VERIFIED", "IMPORTANT")]


def test_wildcard_gate_and_band_join(spark):
    rows = [("k", i, at(t), e) for i, (t, e) in enumerate([(0, None), (600, "E1"), (1200, "E2"), (1201, None), (599, "E2")])]
    df = spark.createDataFrame(rows, "k string, report_id long, received_at timestamp_ntz, error string")
    pairs = {(r.left_id, r.right_id) for r in gates.window_pairs(df, 600, ["k"]).collect()}
    want = {(a, b) for a in range(5) for b in range(a + 1, 5) if abs((rows[a][2] - rows[b][2]).total_seconds()) <= 600}
    assert pairs == want
    met = gates.gate_pairs(df.drop("received_at"), df.drop("received_at"), ["k"], ["error"]).filter("report_id < report_id_r")
    assert {(r.report_id, r.report_id_r) for r in met.collect()} == {(a, b) for a in range(5) for b in range(a + 1, 5) if None in (rows[a][3], rows[b][3]) or rows[a][3] == rows[b][3]}


def test_pairs_of_keys_of_several_parts(spark, monkeypatch):
    monkeypatch.setattr(gates, "PART", 8)
    monkeypatch.setattr(gates, "PIECE", 3)
    rows = [("k" if i % 4 else "m", i if i else None, at(i % 7 * 150), (None, "E1", "E2")[i % 3]) for i in range(60)] + [(None, 60, at(0), "E1")]
    df = spark.createDataFrame(rows, "k string, report_id long, received_at timestamp_ntz, error string")
    met = gates.gate_pairs(df.drop("received_at"), df, ["k"], ["error"])
    assert met.columns == ["k", "report_id", "error", "report_id_r", "received_at_r", "error_r"]
    keyed = [r for r in rows if r[0]]
    want = [(a[0], a[1], a[3], b[1], b[2], b[3]) for a in keyed for b in keyed if a[0] == b[0] and (None in (a[3], b[3]) or a[3] == b[3])]
    assert sorted(map(str, map(tuple, met.collect()))) == sorted(map(str, want))
    pairs = [(r.k, r.left_id, r.right_id, r.gap) for r in gates.window_pairs(df, 600, ["k"]).collect()]
    gaps = [(a[0], a[1], b[1], abs((a[2] - b[2]).total_seconds())) for a in keyed for b in keyed if a[0] == b[0] and a[1] and b[1] and a[1] < b[1]]
    assert sorted(pairs) == sorted(g for g in gaps if g[3] <= 600)


def test_pairs_of_a_table_with_itself_are_made_one_way(spark, monkeypatch):
    """Pieces that hold only lesser ids never become rows, and no pair is lost by them, in whatever column ids come."""
    monkeypatch.setattr(gates, "PIECE", 4)
    monkeypatch.setattr(gates, "PART", 20)
    rows = spark.createDataFrame([(i % 2, None if i % 3 == 0 else f"E{i % 4}", float(i), (i * 37) % 90) for i in range(90)], "k int, error string, rest double, report_id long")
    every = gates.gate_pairs(rows, rows, ["k"], ["error"]).filter("report_id < report_id_r")
    met = gates.gate_pairs(rows, rows, ["k"], ["error"], "report_id")
    assert met.columns == every.columns
    assert sorted((r.report_id, r.report_id_r, r.rest, r.rest_r) for r in met.collect()) == sorted((r.report_id, r.report_id_r, r.rest, r.rest_r) for r in every.collect())


@pytest.mark.parametrize("name", ["gate_pairs", "window_pairs"])
def test_pairs_of_copies_take_few_bytes(spark, tmp_path, name):
    rows = spark.range(2_000).select(
        F.lit("k").alias("k"), F.pmod(F.col("id") * 7919, F.lit(2_000)).alias("report_id"), F.timestamp_seconds(F.col("id") % 25 * 37).alias("received_at"), F.lit("E1").alias("error")
    )
    if name == "gate_pairs":
        met = gates.gate_pairs(rows.drop("received_at"), rows.drop("received_at"), ["k"], ["error"]).filter("report_id < report_id_r").select("k", "report_id", "report_id_r")
    else:
        met = gates.window_pairs(rows, 900, ["k"])
    met.write.parquet(out := f"{tmp_path}/out")
    assert spark.read.parquet(out).count() == 1_999_000
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 2_000_000


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("digits", [1, 6])
def test_similarities_of_several_ranges(spark, monkeypatch, kind, digits):
    for name, value in {"RANGE": 12, "STRIP": 5, "BAND": 40, "BATCH": 7}.items():
        monkeypatch.setattr(signals, name, value)
    rng = random.Random(13)
    cast = (lambda i: None if i is None else f"{i:03}") if kind == "string" else (lambda i: i)
    rows = [("k" if i % 4 else "m", cast(i if i else None), [rng.uniform(-1, 1) for _ in range(3)]) for i in range(70)]
    rows += [("k", cast(100 + i), [1.0, 0.0, 0.0]) for i in range(15)] + [("k", cast(120), [0.0, 0.0, 0.0]), ("k", cast(121), [-1e-9, 1.0, 0.0]), ("k", cast(122), [math.inf, 1.0, 0.0])]
    rows += [("k", cast(7), [0.0, 0.0, 1.0]), (None, cast(200), [1.0, 0.0, 0.0]), (None, cast(201), [1.0, 0.0, 0.0])]

    def similarity(a, b):
        size = math.hypot(*a) * math.hypot(*b)
        x = sum(p * q for p, q in zip(a, b, strict=True)) / size if 0 < size < math.inf else math.nan if size else 0.0
        return x if math.isnan(x) else math.copysign(math.floor(min(abs(x), 1) * 10**digits + 0.5) / 10**digits, x)

    found = signals.similarity_pairs(spark.createDataFrame(rows, f"k string, row_id {kind}, vec array<double>"), ["k"], digits)
    assert found.columns == ["left_id", "right_id", "similarity"]
    keyed = [r for r in rows if r[0] and r[1] is not None]
    want = [(a[1], b[1], similarity(a[2], b[2])) for a in keyed for b in keyed if a[0] == b[0] and a[1] < b[1]]
    got = sorted(map(tuple, found.collect()), key=str)
    assert [str(r) for r in got] == sorted(str(r) for r in want)


def test_recurring_similarities_take_few_bytes(spark, tmp_path):
    rng = random.Random(5)
    rows = [("k", i * 7919 % 1_500, [rng.gauss(0, 1) for _ in range(64)]) for i in range(1_500)]
    signals.similarity_pairs(spark.createDataFrame(rows, "k string, row_id long, vec array<double>"), ["k"], 5).write.parquet(out := f"{tmp_path}/out")
    assert spark.read.parquet(out).count() == 1_124_250
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 6 * 1_124_250
