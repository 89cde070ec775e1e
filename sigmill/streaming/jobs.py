"""Jobs, replays and rate limits as keyed state with event-time timers: nothing stays once its time has passed.

Within a micro-batch events are taken in order of time; a deadline that lies before an event is met before it, whether its
timer has fired or not, so the output does not depend on how the stream is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lifecycle import MAX_ATTEMPTS, RETENTION_HOURS, RETRY_SECONDS, fold_window

LEASE_SECONDS = 300
STALE_SECONDS = 180
TRANSITIONS = "job_id string, at long, transition string, status string, attempts int, error_code string, next_attempt_at long"
_MS, _US = 1000, 1_000_000
#: Added to times of hits, as a stream takes the epoch itself for late.
_DAY_MS = 86_400_000


class Job:
    """One job's state and rules; times are in microseconds.

    A claim is taken if the job waits and its time has come: its lease runs for five minutes, or it is a dead letter if its
    attempts are used up. A failure waits five minutes, or is a dead letter if it is permanent or the last attempt. A deadline
    makes a claimed or failed job ready again.
    """

    def __init__(self, state: tuple | None, permanent: frozenset, most: int):
        self.status, self.attempts, self.error, self.due, self.told = state or (None, 0, None, 0, True)
        self.permanent, self.most = permanent, most

    @property
    def state(self) -> tuple:
        return self.status, self.attempts, self.error, self.due, self.told

    @property
    def over(self) -> bool:
        return self.status in ("COMPLETED", "DEAD_LETTER")

    def _row(self, at: int, transition: str) -> tuple:
        return at, transition, self.status, self.attempts, self.error, self.due

    def deadline(self, now: int) -> list[tuple]:
        if self.told or self.due > now or self.status not in ("PROCESSING", "FAILED"):
            return []
        self.told = True
        return [self._row(self.due, "LEASE_EXPIRED" if self.status == "PROCESSING" else "RETRY_DUE")]

    def event(self, kind: str, at: int, error: str | None) -> list[tuple]:
        out = self.deadline(at)
        if kind == "ENQUEUED" and self.status is None:
            self.status, self.due, self.told = "PENDING", at, True
            return [*out, self._row(at, kind)]
        if kind == "CLAIMED" and self.status in ("PENDING", "FAILED", "PROCESSING") and self.due <= at:
            if self.attempts >= self.most:
                self.status, self.error, self.due = "DEAD_LETTER", "RETRY_EXHAUSTED", at
                return [*out, self._row(at, "DEAD_LETTER")]
            self.status, self.error, self.attempts, self.due, self.told = "PROCESSING", None, self.attempts + 1, at + LEASE_SECONDS * _US, False
            return [*out, self._row(at, kind)]
        if kind == "FAILED" and self.status == "PROCESSING":
            if error in self.permanent or self.attempts >= self.most:
                self.status, self.error, self.due = "DEAD_LETTER", error if error in self.permanent else "RETRY_EXHAUSTED", at
                return [*out, self._row(at, "DEAD_LETTER")]
            self.status, self.error, self.due, self.told = "FAILED", error, at + RETRY_SECONDS * _US, False
            return [*out, self._row(at, kind)]
        if kind == "COMPLETED" and self.status == "PROCESSING":
            self.status = "COMPLETED"
            return [*out, self._row(at, kind)]
        return out


def _frame(key, rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame([(str(key[0]), *r) for r in rows], columns=[c.split()[0] for c in TRANSITIONS.split(", ")])
    return frame.astype({"at": "int64", "attempts": "int32", "next_attempt_at": "int64"})


class JobProcessor(StatefulProcessor):
    """Emits a row for each transition; the state goes with the job's end."""

    def __init__(self, permanent: frozenset, most: int):
        self.permanent, self.most = permanent, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("job", "status string, attempts int, error string, due long, told boolean")

    def _job(self) -> Job:
        return Job(tuple(self.held.get()) if self.held.exists() else None, self.permanent, self.most)

    def _keep(self, job: Job) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if job.status is None or job.over:
            self.held.clear()
            return
        self.held.update(job.state)
        if not job.told:
            self.handle.registerTimer(-(-job.due // _MS))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        job, out = self._job(), []
        for r in pd.concat(list(rows)).sort_values(["micros", "number"]).itertuples():
            out += job.event(r.kind, r.micros, None if r.error_code != r.error_code else r.error_code)
            if job.over:
                break
        self._keep(job)
        yield _frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job = self._job()
        out = job.deadline(expiredTimerInfo.getExpiryTimeInMs() * _MS)
        if self.held.exists():
            self.held.update(job.state)
        yield _frame(key, out)

    def close(self) -> None:
        pass


def job_stream(events: DataFrame, permanent: tuple[str, ...] = (), most: int = MAX_ATTEMPTS, delay: str = "10 minutes") -> DataFrame:
    """TRANSITIONS of job events (job_id, number, kind, error_code, at): claims, leases, retries and dead letters over time.

    kind: ENQUEUED, CLAIMED, FAILED or COMPLETED; number orders the events of one time. Needs the RocksDB state store.
    """
    rows = events.withColumn("micros", F.unix_micros("at")).withWatermark("at", delay)
    return rows.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=JobProcessor(frozenset(permanent), most), outputStructType=TRANSITIONS, outputMode="Append", timeMode="EventTime"
    )


def stale_stream(analyses: DataFrame, seconds: int = STALE_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """(report_id, since): analyses (report_id, status, at) that stay PENDING for so many seconds without another event.

    Each stretch of pending is told once; any later event of the report ends it, and a new PENDING begins another.
    """

    def run(key, frames, state):
        out, since = [], state.get[0] if state.exists else None
        if state.hasTimedOut:
            out.append(since)
            since = None
        else:
            for r in pd.concat(list(frames)).sort_values("micros").itertuples():
                if since is not None and r.micros >= since + seconds * _US:
                    out.append(since)
                since = r.micros if r.status == "PENDING" else None
        if since is None:
            state.remove() if state.exists else None
        else:
            end = since // _MS + seconds * _MS
            if end <= state.getCurrentWatermarkMs():
                out.append(since)
                state.remove() if state.exists else None
            else:
                state.update((since,))
                state.setTimeoutTimestamp(end)
        yield pd.DataFrame({"report_id": [str(key[0])] * len(out), "since": pd.to_datetime(pd.Series(out, dtype="int64"), unit="us")})

    rows = analyses.withColumn("micros", F.unix_micros("at")).withWatermark("at", delay)
    return rows.groupBy("report_id").applyInPandasWithState(run, "report_id string, since timestamp", "since long", "append", "EventTimeTimeout")


def rate_limit_stream(hits: DataFrame, window: int, limit: int, delay: str = "1 minute") -> DataFrame:
    """Streaming twin of operators.lifecycle.rate_limit: (bucket, hit_id, allowed, hit_number) of hits (bucket, hit_id, at in seconds).

    A bucket's state goes when the watermark passes the end of its window, as the next hit begins another.
    """

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        begin, count = state.get if state.exists else (None, 0)
        frame = pd.concat(list(frames)).sort_values(["at", "hit_id"])
        found, begin, count = fold_window(frame["at"].tolist(), window, limit, begin, count)
        end = int((begin + window) * 1000) + 1 + _DAY_MS
        if end > state.getCurrentWatermarkMs():
            state.update((begin, count))
            state.setTimeoutTimestamp(end)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"bucket": str(key[0]), "hit_id": frame["hit_id"], "allowed": [f[0] for f in found], "hit_number": [f[1] for f in found]})

    rows = hits.withColumn("_time", F.timestamp_micros((F.col("at") * _US).cast("long") + _DAY_MS * 1000)).withWatermark("_time", delay)
    return rows.groupBy("bucket").applyInPandasWithState(
        run, "bucket string, hit_id long, allowed boolean, hit_number int", "begin double, hits int", "append", "EventTimeTimeout"
    )


def idempotency_stream(requests: DataFrame, retention: int = RETENTION_HOURS * 3600, delay: str = "10 minutes") -> DataFrame:
    """Streaming twin of operators.lifecycle.idempotency: (request_id, outcome) of (request_id, key, payload_sha256, at).

    A key is remembered for `retention` seconds after its first request; then its state goes and the next one is NEW.
    """

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        payload, until = state.get if state.exists else (None, 0)
        out = []
        for r in pd.concat(list(frames)).sort_values(["micros", "request_id"]).itertuples():
            if payload is None or r.micros >= until:
                payload, until = r.payload_sha256, r.micros + retention * _US
                out.append((r.request_id, "NEW"))
            else:
                out.append((r.request_id, "REPLAY" if r.payload_sha256 == payload else "CONFLICT"))
        end = -(-until // _MS)
        if end > state.getCurrentWatermarkMs():
            state.update((payload, until))
            state.setTimeoutTimestamp(end)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["request_id", "outcome"])

    rows = requests.withColumn("micros", F.unix_micros("at")).withWatermark("at", delay)
    return rows.groupBy("key").applyInPandasWithState(run, "request_id long, outcome string", "payload string, until long", "append", "EventTimeTimeout")
