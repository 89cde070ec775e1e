"""What operators decide, as an ordered log: merges of signals, and registrations and approvals of policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import components

#: Requests up to which one task holds them all in order; beyond, those that are linked by signals meet in a task.
FEW_REQUESTS = 50_000

_JUDGED = "request_id long, source_id string, target_id string, outcome string, before_status string, root string, path array<long>, filters array<string>, own_filters array<string>"


def judge_merges(signals: DataFrame, requests: DataFrame, keys: list[str], wildcards: list[str]) -> DataFrame:
    """_JUDGED for merge requests (request_id, source_id, target_id), each judged on what the ones before it left.

    root: the open signal where the members of a merged source are in the end; path: the requests that took them there, the
    last one first, so that of two rows of a report the one with the smaller path stays; filters: the root's wildcards then;
    own_filters: those of the source when it closed.
    A request is refused if it names one signal twice (INVALID_MERGE_REQUEST), if a signal is missing (SIGNAL_NOT_FOUND) or
    closed by then (INVALID_SIGNAL_STATE), or if the gates conflict: different keys, or two different wildcards.
    """
    gate = [*keys, *wildcards]
    text = [F.to_json(F.struct(*keys)).alias("keys") if keys else F.lit("").alias("keys"), F.array(*[F.col(c).cast("string") for c in wildcards]).cast("array<string>").alias("filters")]
    states = signals.select("signal_id", "status", *gate).select("signal_id", F.struct("status", *text).alias("state"))
    rows = requests.select("request_id", "source_id", "target_id")
    if rows.count() <= FEW_REQUESTS:
        rows = rows.withColumn("part", F.lit(""))
    else:
        parts = components(rows.select(F.col("source_id").alias("x"), F.col("target_id").alias("y")))
        rows = rows.join(parts.withColumnRenamed("node", "source_id"), "source_id", "left").withColumn("part", F.coalesce("root", "source_id")).drop("root")
    for side in ("source", "target"):
        rows = rows.join(states.select(F.col("signal_id").alias(f"{side}_id"), F.col("state").alias(side)), f"{side}_id", "left")
    dealt = rows.repartition("part").sortWithinPartitions("part", "request_id").select("part", "request_id", "source_id", "target_id", "source", "target")

    def judged(source, target, states) -> str:
        if source == target:
            return "INVALID_MERGE_REQUEST"
        if states[source] is None or states[target] is None:
            return "SIGNAL_NOT_FOUND"
        if "CLOSED" in (states[source]["status"], states[target]["status"]):
            return "INVALID_SIGNAL_STATE"
        a, b = states[source], states[target]
        apart = any(x is not None and y is not None and x != y for x, y in zip(a["filters"], b["filters"], strict=True))
        return "SIGNAL_GATE_CONFLICT" if a["keys"] != b["keys"] or apart else "MERGED"

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in _JUDGED.split(", ")]
        kinds = [pa.int64(), *[pa.string()] * 5, pa.list_(pa.int64()), *[pa.list_(pa.string())] * 2]

        def told(rows, states, into):
            out = []
            for request, source, target, outcome, before in rows:
                root, path = source, []
                if outcome == "MERGED":
                    while root in into:
                        root, by = into[root]
                        path.append(by)
                filters = [states[x]["filters"] for x in (root, source)] if outcome == "MERGED" else [None, None]
                out.append((request, source, target, outcome, before, root, path[::-1], *filters))
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        part, rows, states, into = None, [], {}, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if rows:
                        yield told(rows, states, into)
                    part, rows, states, into = row["part"], [], {}, {}
                source, target = row["source_id"], row["target_id"]
                states.setdefault(source, row["source"])
                states.setdefault(target, row["target"])
                outcome = judged(source, target, states)
                rows.append((row["request_id"], source, target, outcome, (states[source] or {}).get("status")))
                if outcome == "MERGED":
                    given = states[source]["filters"]
                    states[target] = states[target] | {"filters": [y if y is not None else x for x, y in zip(given, states[target]["filters"], strict=True)]}
                    states[source] = states[source] | {"status": "CLOSED"}
                    into[source] = target, row["request_id"]
        if rows:
            yield told(rows, states, into)

    return dealt.mapInArrow(run, _JUDGED)


def audit_events(judged: DataFrame, requests: DataFrame, done: str, action: str, target: str) -> DataFrame:
    """The log entries of the requests that were carried out: signal_id is the source; at, actor_id and reason are the request's."""
    kept = judged.filter(F.col("outcome") == done).select("request_id", F.col("source_id").alias("signal_id"), F.col(target).alias("target_signal_id"), "before_status", "after_status")
    said = requests.select("request_id", F.col("at").alias("created_at"), "actor_id", "reason").distinct()
    return kept.join(said, "request_id").select(
        "request_id", F.lit(action).alias("action"), "signal_id", "target_signal_id", F.lit("operator").alias("actor_type"), "actor_id", "before_status", "after_status", "reason", "created_at"
    )


def policy_log(events: DataFrame) -> dict[str, DataFrame]:
    """outcomes (event_id, policy_version, kind, outcome), policies and audit (event_id, action, policy_version, actor_id, created_at).

    events: event_id, kind (REGISTER or APPROVE), policy_version, activate, at, actor_id, evidence_sha256; in order of event_id.
    A version is registered once, as EXPERIMENTAL; one that is registered with activate takes the place of the active one.
    An approval is refused for an unknown version, for one that is approved already, and for one that is not the active one.
    """
    entered = events.filter("kind = 'REGISTER'").groupBy("policy_version").agg(F.min("event_id").alias("registered"))
    first = events.join(entered, "policy_version", "left")
    accepted = (F.col("kind") == "REGISTER") & (F.col("event_id") == F.col("registered"))
    # A row for each version; versions are configuration, not data.
    activated = first.filter(accepted & F.col("activate")).select("policy_version", F.col("event_id").alias("begin"))
    spans = activated.withColumn("end", F.lead("begin").over(W.orderBy("begin")))
    known = first.join(spans, "policy_version", "left")
    active = F.coalesce((F.col("begin") <= F.col("event_id")) & (F.col("end").isNull() | (F.col("event_id") < F.col("end"))), F.lit(False))
    asked = known.withColumn("_asked", (F.col("kind") == "APPROVE") & active)
    granted = asked.filter("_asked").groupBy("policy_version").agg(F.min("event_id").alias("granted"))
    judged = asked.join(granted, "policy_version", "left")
    number = F.col("event_id")
    approval = (
        F.when(F.col("registered").isNull() | (F.col("registered") > number), "SIGNAL_POLICY_NOT_FOUND")
        .when(F.coalesce(F.col("granted") < number, F.lit(False)), "INVALID_SIGNAL_POLICY_STATE")
        .when(~F.col("_asked"), "SIGNAL_POLICY_NOT_ACTIVE")
        .otherwise("APPROVED")
    )
    registration = F.when(accepted, "REGISTERED").otherwise("POLICY_VERSION_EXISTS")
    outcomes = judged.withColumn("outcome", F.when(F.col("kind") == "REGISTER", registration).otherwise(approval))
    done = outcomes.filter("outcome IN ('REGISTERED', 'APPROVED')")
    approved = done.filter("outcome = 'APPROVED'").select("policy_version", F.col("actor_id").alias("approved_by"), F.col("at").alias("approved_at"), "evidence_sha256")
    policies = done.filter("outcome = 'REGISTERED'").select("policy_version", F.col("at").alias("created_at"), (F.col("begin").isNotNull() & F.col("end").isNull()).alias("is_active"))
    status = F.when(F.col("approved_at").isNull(), "EXPERIMENTAL").otherwise("APPROVED")
    policies = policies.join(approved, "policy_version", "left").select("policy_version", status.alias("status"), "is_active", "created_at", "approved_by", "approved_at", "evidence_sha256")
    audit = outcomes.filter("outcome = 'APPROVED'").select("event_id", F.lit("SIGNAL_POLICY_APPROVED").alias("action"), "policy_version", "actor_id", F.col("at").alias("created_at"))
    return {"outcomes": outcomes.select("event_id", "policy_version", "kind", "outcome"), "policies": policies, "audit": audit}


def closed(signals: DataFrame, at: Column, gone: Column) -> dict[str, Column]:
    """The columns of a closed signal that has them: closed_at, and no representative."""
    found = {"closed_at": F.when(gone, at).otherwise(F.col("closed_at"))} if "closed_at" in signals.columns else {}
    return found | ({"representative_id": F.when(gone, F.lit(None)).otherwise(F.col("representative_id"))} if "representative_id" in signals.columns else {})
