"""Merges, splits and policies as ordered logs, against plain sequential forms."""

import datetime as dt
import random

import pytest

from sigmill.operators import decisions, graph, signals

T0 = dt.datetime(2026, 8, 29, 3, 0, 0)
WINDOW, LEAST, REVIEW = 600, 3, 5
MEMBERS = "signal_id string, report_id long, session_id string, received_at timestamp_ntz, purge_at timestamp_ntz"
SIGNALS = (
    "signal_id string, status string, closure_reason string, issue_type string, error_filter string, raw_report_count int, unique_sessions int, "
    "review_priority boolean, first_report_at timestamp_ntz, last_report_at timestamp_ntz, purge_at timestamp_ntz, closed_at timestamp_ntz, representative_id long"
)
REQUESTS = "request_id long, source_id string, target_id string, at timestamp_ntz, actor_id string, reason string"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def world(rng, n, reports):
    states = {f"s{i:02}": [rng.choice(["CANDIDATE", "SIGNAL_DETECTED", "UNDER_REVIEW", "CLOSED"] if rng.random() < 0.4 else ["CANDIDATE"]), rng.choice("AB"), rng.choice([None, None, "E1", "E2"])] for i in range(n)}
    members = {(rng.choice(sorted(states)), rng.randrange(reports)) for _ in range(reports * 2)}
    facts = {r: (f"u{rng.randrange(8)}", rng.randrange(0, 1500), [rng.random() for _ in range(4)]) for r in range(reports)}
    return states, members, facts


def frames(spark, states, members, facts):
    found = [(s, st, None, k, f, 0, 0, False, at(0), at(0), at(0), None, None) for s, (st, k, f) in states.items()]
    rows = [(s, r, facts[r][0], at(facts[r][1]), at(facts[r][1] + 9999)) for s, r in sorted(members)]
    return spark.createDataFrame(found, SIGNALS), spark.createDataFrame(rows, MEMBERS), spark.createDataFrame([(r, r + 100, f[2]) for r, f in facts.items()], "report_id long, member_id long, vec array<double>")


def counted(rows, facts):
    if not rows:
        return 0, 0, None
    last = max(facts[r][1] for r in rows)
    inside = [r for r in rows if facts[r][1] >= last - WINDOW]
    return len(inside), len({facts[r][0] for r in inside}), inside


def medoid(rows, facts):
    import numpy as np

    units = {r: np.array(facts[r][2]) / np.linalg.norm(facts[r][2]) for r in rows}
    total = sum(units.values())
    return min(rows, key=lambda r: (-round(float(units[r] @ total) / len(rows), 9), r)) + 100


def follow(states, s, rows, facts, deletion=False):
    _, sessions, _ = counted(rows, facts)
    if deletion and sessions < LEAST:
        states[s][0] = "CLOSED"
    elif states[s][0] in ("CANDIDATE", "SIGNAL_DETECTED"):
        states[s][0] = "SIGNAL_DETECTED" if sessions >= LEAST else "CANDIDATE"


@pytest.mark.parametrize("few", [decisions.FEW_REQUESTS, 0])
def test_merges_in_order_equal_a_plain_log(spark, monkeypatch, few):
    monkeypatch.setattr(decisions, "FEW_REQUESTS", few)
    rng = random.Random(few)
    states, members, facts = world(rng, 14, 60)
    names = [*sorted(states), "absent"]
    requests = [(i * 3, rng.choice(names), rng.choice(names), at(i), "op", f"why {i}") for i in range(30)]
    found, rows, vectors = frames(spark, states, members, facts)
    out = signals.apply_merges(found, rows, spark.createDataFrame(requests, REQUESTS).repartition(4), ["issue_type"], ["error_filter"], WINDOW, LEAST, REVIEW, vectors)

    now, held = {s: list(v) for s, v in states.items()}, {s: [r for t, r in sorted(members) if t == s] for s in states}
    outcomes, events, closed, targets = {}, [], {}, set()
    for number, a, b, when, actor, why in requests:
        if a == b:
            result = "INVALID_MERGE_REQUEST"
        elif a not in now or b not in now:
            result = "SIGNAL_NOT_FOUND"
        elif "CLOSED" in (now[a][0], now[b][0]):
            result = "INVALID_SIGNAL_STATE"
        elif now[a][1] != now[b][1] or (now[a][2] and now[b][2] and now[a][2] != now[b][2]):
            result = "SIGNAL_GATE_CONFLICT"
        else:
            result = "MERGED"
            held[b] += [r for r in held[a] if r not in held[b]]
            held[a] = []
            now[b][2] = now[b][2] or now[a][2]
            now[a][0], closed[a] = "CLOSED", when
            events.append((number, a, b, states[a][0], "CLOSED", actor, why, when))
            targets.add(b)
            follow(now, b, held[b], facts)
        outcomes[number] = result
    assert set(outcomes.values()) >= {"MERGED", "INVALID_SIGNAL_STATE", "SIGNAL_GATE_CONFLICT", "SIGNAL_NOT_FOUND"}
    assert {r.request_id: r.outcome for r in out["outcomes"].collect()} == outcomes
    assert sorted((r.signal_id, r.report_id) for r in out["members"].collect()) == sorted((s, r) for s, rs in held.items() for r in rs)
    assert sorted((r.request_id, r.signal_id, r.target_signal_id, r.before_status, r.after_status, r.actor_id, r.reason, r.created_at) for r in out["events"].collect()) == sorted(events)
    got = {r.signal_id: r for r in out["signals"].collect()}
    assert got.keys() == states.keys() and out["signals"].count() == len(states)
    for s, r in got.items():
        assert (r.status, r.error_filter, r.closed_at) == (now[s][0], now[s][2], closed.get(s)), s
        assert r.closure_reason == ("MERGED" if s in closed else None)
        if s in targets and s not in closed and held[s]:
            raw, sessions, inside = counted(held[s], facts)
            assert (r.raw_report_count, r.unique_sessions, r.review_priority, r.representative_id) == (raw, sessions, sessions >= REVIEW, medoid(inside, facts))


def test_the_row_that_was_there_first_stays(spark):
    """One report in three signals: the last target's own row wins, then that of the signal that came first."""
    rows = [(s, 1, s, at(0), at(9)) for s in "abc"] + [(s, 2, s, at(0), at(9)) for s in "ab"]
    found = spark.createDataFrame([(s, "CANDIDATE", None, "A", None, 0, 0, False, at(0), at(0), at(0), None, None) for s in "abc"], SIGNALS)
    for order, kept in (([("a", "b"), ("b", "c")], "b"), ([("a", "c"), ("b", "c")], "a"), ([("b", "c"), ("a", "c")], "b")):
        requests = spark.createDataFrame([(i, s, t, at(i), "op", "x") for i, (s, t) in enumerate(order)], REQUESTS)
        out = signals.apply_merges(found, spark.createDataFrame(rows, MEMBERS), requests, ["issue_type"], ["error_filter"], WINDOW, LEAST, REVIEW)
        assert sorted((r.signal_id, r.report_id, r.session_id) for r in out["members"].collect()) == [("c", 1, "c"), ("c", 2, kept)]
        assert out["signals"].count() == 3


def test_splits_close_and_represent(spark):
    rng = random.Random(5)
    states, members, facts = world(rng, 6, 40)
    states = {s: ["CANDIDATE", *v[1:]] for s, v in states.items()}
    found, rows, vectors = frames(spark, states, members, facts)
    asked = []
    for i, s in enumerate(sorted(states)):
        own = [r for t, r in sorted(members) if t == s]
        asked += [(i, s, f"{s}-new", r, at(i), "op", "apart") for r in own[: len(own) - 2]]
    requests = spark.createDataFrame(asked, "request_id long, source_id string, new_id string, report_id long, at timestamp_ntz, actor_id string, reason string")
    out = signals.apply_splits(found, rows, requests, WINDOW, LEAST, REVIEW, vectors)
    got = {r.signal_id: r for r in out["signals"].collect()}
    events = {r.signal_id: r for r in out["events"].collect()}
    assert len(got) == 12 and events.keys() == states.keys()
    for i, s in enumerate(sorted(states)):
        left = [r.report_id for r in out["members"].filter(f"signal_id = '{s}'").collect()]
        raw, sessions, inside = counted(left, facts)
        assert got[s].status == "CLOSED" and got[s].closed_at == at(i) and sessions < LEAST  # two reports are too few
        assert got[s].representative_id == medoid(inside, facts) and events[s].before_status == "CLOSED" and events[s].target_signal_id == f"{s}-new"
        new = [r.report_id for r in out["members"].filter(f"signal_id = '{s}-new'").collect()]
        raw, sessions, inside = counted(new, facts)
        assert (got[f"{s}-new"].raw_report_count, got[f"{s}-new"].unique_sessions, got[f"{s}-new"].closed_at) == (raw, sessions, None)
        assert got[f"{s}-new"].representative_id == medoid(inside, facts)


def test_no_requests(spark):
    found, rows, _ = frames(spark, *world(random.Random(1), 3, 10))
    out = signals.apply_merges(found, rows, spark.createDataFrame([], REQUESTS), ["issue_type"], ["error_filter"], WINDOW, LEAST, REVIEW)
    assert out["outcomes"].count() == out["events"].count() == 0 and out["signals"].count() == 3


EVENTS = "event_id long, kind string, policy_version string, activate boolean, at timestamp_ntz, actor_id string, evidence_sha256 string"


def test_policies_follow_a_plain_log(spark):
    rng = random.Random(3)
    events = [(i, rng.choice(["REGISTER", "APPROVE"]), f"v{rng.randrange(12)}", rng.random() < 0.6, at(i), f"op{i}", f"sha{i}") for i in range(80)]
    policies, outcomes = {}, {}
    for i, kind, version, activate, when, actor, sha in events:
        p = policies.get(version)
        if kind == "REGISTER":
            outcomes[i] = "REGISTERED" if p is None else "POLICY_VERSION_EXISTS"
            if p is None:
                if activate:
                    for q in policies.values():
                        q["is_active"] = False
                policies[version] = {"status": "EXPERIMENTAL", "is_active": activate, "created_at": when, "approved_by": None, "approved_at": None, "evidence_sha256": None}
        elif p is None:
            outcomes[i] = "SIGNAL_POLICY_NOT_FOUND"
        elif p["status"] != "EXPERIMENTAL":
            outcomes[i] = "INVALID_SIGNAL_POLICY_STATE"
        elif not p["is_active"]:
            outcomes[i] = "SIGNAL_POLICY_NOT_ACTIVE"
        else:
            outcomes[i] = "APPROVED"
            p.update(status="APPROVED", approved_by=actor, approved_at=when, evidence_sha256=sha)
    out = decisions.policy_log(spark.createDataFrame(events, EVENTS))
    assert {r.event_id: r.outcome for r in out["outcomes"].collect()} == outcomes
    got = {r.policy_version: {k: r[k] for k in ("status", "is_active", "created_at", "approved_by", "approved_at", "evidence_sha256")} for r in out["policies"].collect()}
    assert got == policies and sum(p["is_active"] for p in policies.values()) == 1
    assert {r.event_id for r in out["audit"].collect()} == {i for i, o in outcomes.items() if o == "APPROVED"}


def test_components_equal_a_plain_search(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for x, y in edges:
        a, b = sorted((find(x), find(y)))
        parent[b] = a
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = graph.components(spark.createDataFrame(edges, "x long, y long")).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert graph.components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_a_purge_corrects_the_signals_that_lose_reports(spark):
    """Of four signals one keeps enough, one too little, one nothing, and one is untouched; then each one's own retention is judged."""
    from pyspark.sql import functions as F

    from sigmill.operators import lifecycle

    rows, number = [], 0
    for name, old, new in (("full", 2, 3), ("thin", 3, 1), ("bare", 4, 0), ("calm", 0, 3)):
        for i in range(old + new):
            number += 1
            rows.append((name, number, f"u{i}", at(i if i < old else 300 + i), at(50 if i < old else 9000)))
    members = spark.createDataFrame(rows, MEMBERS)
    found = spark.createDataFrame([(s, "SIGNAL_DETECTED", None, "A", None, 9, 9, True, at(0), at(1), at(60 if s == "bare" else 9000), None, None) for s in ("full", "thin", "bare", "calm")], SIGNALS)
    none = lambda schema: spark.createDataFrame([], schema)
    tables = {
        "reports": members.select("report_id", "purge_at"), "attachments": none("report_id long, object_key string"), "signal_members": members, "signal_clusters": found,
        "object_deletion_jobs": none("object_key string, status string, purge_at timestamp_ntz, next_attempt_at timestamp_ntz"), "idempotency_records": none("purge_at timestamp_ntz"),
        "audit_logs": none("action string, fingerprint string, created_at timestamp_ntz"), "agent_tokens": none("expires_at timestamp_ntz"),
        "rate_limit_buckets": none("expires_at timestamp_ntz"), "signal_audit_events": none("purge_at timestamp_ntz"),
    }
    now = F.lit(at(100)).cast("timestamp_ntz")
    out = lifecycle.purge_with_signals(tables, now, WINDOW, LEAST, REVIEW)
    got = {r.signal_id: r for r in out["signal_clusters"].collect()}
    assert got.keys() == {"full", "thin", "calm"}  # bare has passed its own retention
    assert (got["full"].status, got["full"].raw_report_count, got["full"].unique_sessions, got["full"].review_priority, got["full"].closed_at) == ("SIGNAL_DETECTED", 3, 3, False, None)
    assert (got["thin"].status, got["thin"].closure_reason, got["thin"].raw_report_count, got["thin"].closed_at) == ("CLOSED", "EVIDENCE_RECALCULATED", 1, at(100))
    assert (got["calm"].status, got["calm"].raw_report_count) == ("SIGNAL_DETECTED", 9)
    assert out["signal_members"].count() == 7 and out["reports"].count() == 7 and out["audit_logs"].count() == 9
    bare = signals.detach_reports(found, members, members.filter("signal_id = 'bare'"), now, WINDOW, LEAST, REVIEW)["signals"].filter("signal_id = 'bare'").first()
    assert (bare.status, bare.raw_report_count, bare.unique_sessions, bare.last_report_at) == ("CLOSED", 0, 0, at(1))


def test_pair_facts_equal_rows_of_pairs(spark):
    from pyspark.sql import functions as F

    from sigmill.operators import metrics

    rng = random.Random(6)
    rows = [("AB"[i % 2], i, [rng.uniform(-1, 1) for _ in range(4)], rng.choice([None, 1, 2]), rng.choice([None, "x", "y"])) for i in range(60)]
    df = spark.createDataFrame(rows, "gate string, vec_id long, vec array<double>, label int, type string")
    sims = signals.similarity_pairs(df.select("gate", F.col("vec_id").alias("row_id"), "vec"), ["gate"])
    for side in ("left", "right"):
        sims = sims.join(df.select(F.col("vec_id").alias(f"{side}_id"), F.col("label").alias(f"{side}_label"), F.col("type").alias(f"{side}_type")), f"{side}_id")
    want = {(r.reason, r.same): tuple(r)[2:] for r in metrics.describe_pairs(metrics.labelled_pairs(sims)).collect()}
    got = {(r.reason, r.same): tuple(r)[2:] for r in metrics.pair_facts(df, ["gate"]).collect()}
    assert got.keys() == want.keys() and len(got) == 6
    for k, row in got.items():
        assert row == pytest.approx(want[k], abs=2e-6), k
