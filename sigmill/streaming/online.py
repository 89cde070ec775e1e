"""Streams: incremental clustering as keyed state, hourly volume, and single delivery.

State is kept for each gate, and within a gate for each cluster.
Within a micro-batch reports are taken in order of (received_at, report_id), so
a stream that brings them in order ends in the state of the batch operator; a
later report is scored by the reports around its own time while these are
retained. Clusters leave the state when the gate's latest report is older than
their last one by the retention, and with a timer in gates that get no reports
any more.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.clustering import MEMBERS, IncrementalGate, Policy, member_rows, usable
from ..operators.lifecycle import RETENTION_HOURS


class GateProcessor(StatefulProcessor):
    """Clusters of one gate; emits the members of the clusters that a batch changed.

    A cluster that was merged into another comes once more, as a row without report whose status is CLOSED and whose
    representative is the other cluster. Rows without id, time or vector and repeated ids change nothing.
    """

    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        idle = RETENTION_HOURS * 3_600_000
        self.clusters = handle.getMapState("clusters", "id long", "data binary", idle)
        self.latest = handle.getValueState("latest", "at long", idle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        retention = RETENTION_HOURS * 3600
        gate = IncrementalGate(self.policy, lateness=max(0, retention - self.policy.window))
        if self.latest.exists():
            gate.restore([pickle.loads(data[0]) for data in self.clusters.values()], self.latest.get()[0])
        before = set(gate.clusters)
        frame = pd.concat(list(rows)).sort_values(["at", "report_id"])
        known = {m[0] for c in gate.clusters.values() for m in c.members}
        none = lambda x: None if x is None or x != x else x
        for r in frame.itertuples():
            if r.report_id not in known and (gate.latest is None or r.at >= gate.latest - retention * 1_000_000):
                known.add(r.report_id)
                gate.add(r.report_id, r.session_id, r.at, r.vec, none(r.submission_filter), none(r.error_filter))
        changed = [gate.clusters[i] for i in sorted(gate.changed & set(gate.clusters))]
        closed = [(a, b) for a, b in gate.closed if a in before]
        out = member_rows(changed) + [(a, None, None, "CLOSED", None, None, None, None, b) for a, b in closed]
        # What left with its retention leaves the state; the others are written if they changed.
        gone = {c.id for c in gate.passed()}
        for cluster in changed:
            if cluster.id not in gone:
                cluster.slot = None
                self.clusters.updateValue((cluster.id,), (pickle.dumps(cluster),))
        for i in (before & gone) | {a for a, _ in closed}:
            self.clusters.removeKey((i,))
        if gate.latest is not None:
            self.latest.update((gate.latest,))
        frame = pd.DataFrame(out, columns=[f.split()[0] for f in MEMBERS.split(", ")])
        yield frame.astype({f.split()[0]: "Int64" for f in MEMBERS.split(", ") if f.endswith("long")})

    def close(self) -> None:
        pass


def online_stream(reports: DataFrame, policy: Policy, keys: list[str]) -> DataFrame:
    """Streaming twin of operators.clustering.online_clusters; needs the RocksDB state store."""
    return usable(reports, keys).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=GateProcessor(policy), outputStructType=MEMBERS, outputMode="Update", timeMode="ProcessingTime"
    )


def hourly_stream(reports: DataFrame, delay: str = "72 hours") -> DataFrame:
    """(bucket_start, raw_report_count): reports of each hour; late ones count while the watermark allows."""
    hour = F.window("received_at", "1 hour")
    return reports.withWatermark("received_at", delay).groupBy(hour).agg(F.count("*").alias("raw_report_count")).select(F.col("window.start").alias("bucket_start"), "raw_report_count")


def once_only(reports: DataFrame, delay: str = "72 hours") -> DataFrame:
    """Reports without repeated deliveries of an id inside the watermark."""
    return reports.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["report_id"])
