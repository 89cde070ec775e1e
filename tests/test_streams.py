"""Streams cut into micro-batches, against batch operators and plain folds."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sigmill.operators import gates, lifecycle
from sigmill.streaming import evidence, jobs, sink

T0 = dt.datetime(2026, 8, 29, 3, 0, 0)
SECOND = dt.timedelta(seconds=1)


def at(seconds):
    return T0 + seconds * SECOND


def source(spark, folder, parts, schema):
    """A stream that gives one part a micro-batch."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:04}")
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def run(df, mode, folder):
    seen = []
    query = df.writeStream.foreachBatch(lambda b, i: seen.append(b.collect())).outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination(300)
    last = query.lastProgress
    return [r for batch in seen for r in batch], seen, last


def cut(rows, n):
    return [rows[i : i + n] for i in range(0, len(rows), n)]


def test_hourly_sessions_equal_the_batch_counts(spark, tmp_path):
    """Two hours late counts while the watermark allows it; a report behind it doesn't; the last hours stay open."""
    rng = random.Random(1)
    schema = "report_id long, session_id string, received_at timestamp"
    rows = [(i, None if i % 17 == 0 else f"s{rng.randrange(9)}", at(60 * i + (-7000 if i % 10 == 9 else 0))) for i in range(600)]
    dropped = (9999, "far", at(-100_000))
    make = source(spark, str(tmp_path / "in"), [*cut(rows, 150), [dropped], [(10_000, "end", at(60 * 600 + 90_000))]], schema)
    got, _, _ = run(evidence.hourly_sessions_stream(make(), "3 hours"), "append", str(tmp_path / "cp"))
    batch = spark.createDataFrame(rows, schema).groupBy(F.date_trunc("hour", "received_at").alias("h")).agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("s"))
    want = {r.h: (r.n, r.s) for r in batch.collect()}
    assert {r.bucket_start: (r.raw_report_count, r.unique_sessions) for r in got} == want and len(got) == len(want)


def test_window_pairs_equal_the_batch_pairs(spark, tmp_path):
    rng = random.Random(2)
    schema = "gate string, report_id long, received_at timestamp"
    rows = sorted((("A", "B")[i % 2], i, at(rng.randrange(0, 20_000))) for i in range(160))
    rows += [("C", 1000, at(0)), ("C", 1001, at(600)), ("C", 1002, at(1201)), ("D", 1003, at(600))]
    rows.sort(key=lambda r: r[2])
    make = source(spark, str(tmp_path / "in"), [*cut(rows, 41), [("Z", 5000, at(200_000))]], schema)
    got, _, last = run(evidence.window_pairs_stream(make(), make(), 600, ["gate"]), "append", str(tmp_path / "cp"))
    batch = gates.window_pairs(spark.createDataFrame(rows, schema), 600, ["gate"])
    want = {(r.gate, r.left_id, r.right_id, r.gap) for r in batch.collect()}
    assert {(r.gate, r.left_id, r.right_id, r.gap) for r in got} == want and len(got) == len(want)
    assert ("C", 1000, 1001, 600.0) in want and not any(1002 in w for w in want)
    assert sum(s["numRowsTotal"] for s in last["stateOperators"]) <= 4  # what can't meet any more has left


def test_rate_limits_forget_past_windows(spark, tmp_path):
    rng = random.Random(3)
    schema = "bucket string, hit_id long, at double"
    rows = sorted(((f"b{rng.randrange(6)}", i, float(rng.randrange(0, 900))) for i in range(200)), key=lambda r: (r[2], r[1]))
    make = source(spark, str(tmp_path / "in"), [*cut(rows, 33), [("end", 999, 100_000.0)], [("end", 1000, 100_001.0)]], schema)
    got, _, last = run(jobs.rate_limit_stream(make(), 60, 3), "append", str(tmp_path / "cp"))
    batch = lifecycle.rate_limit(spark.createDataFrame(rows, schema), 60, 3)
    assert {(r.bucket, r.hit_id, r.allowed, r.hit_number) for r in got if r.bucket != "end"} == {tuple(r) for r in batch.collect()}
    assert last["stateOperators"][0]["numRowsTotal"] == 1


def test_replays_are_known_for_the_retention(spark, tmp_path):
    schema = "request_id long, key string, payload_sha256 string, at timestamp"
    rows = [(1, "a", "x", at(0)), (2, "a", "x", at(10)), (3, "a", "y", at(20)), (4, "b", "z", at(30)), (5, "a", "y", at(99)), (6, "a", "y", at(100)), (7, "a", "x", at(150)), (8, "b", "z", at(10_000))]
    make = source(spark, str(tmp_path / "in"), [rows[:2], rows[2:5], rows[5:], [(9, "c", "c", at(100_000))], [(10, "c", "d", at(100_001))]], schema)
    got, _, last = run(jobs.idempotency_stream(make(), 100), "append", str(tmp_path / "cp"))
    outcomes = {r.request_id: r.outcome for r in got}
    assert outcomes == {1: "NEW", 2: "REPLAY", 3: "CONFLICT", 4: "NEW", 5: "CONFLICT", 6: "NEW", 7: "CONFLICT", 8: "NEW", 9: "NEW", 10: "CONFLICT"}
    assert last["stateOperators"][0]["numRowsTotal"] == 1
    first = spark.createDataFrame(rows[:5], schema)
    assert {r.request_id: r.outcome for r in lifecycle.idempotency(first).collect()} == {k: outcomes[k] for k in range(1, 6)}


def test_pending_analyses_become_stale(spark, tmp_path):
    schema = "report_id string, status string, at timestamp"
    rows = [("a", "PENDING", at(0)), ("b", "PENDING", at(5)), ("b", "DONE", at(184)), ("c", "PENDING", at(10)), ("c", "DONE", at(190)), ("a", "PENDING", at(500)), ("a", "DONE", at(600)), ("d", "PENDING", at(700))]
    for n in (1, 3, 8):
        make = source(spark, str(tmp_path / f"in{n}"), [*cut(rows, n), [("z", "DONE", at(9000))], [("z", "DONE", at(9001))]], schema)
        got, _, last = run(jobs.stale_stream(make()), "append", str(tmp_path / f"cp{n}"))
        assert sorted((r.report_id, r.since) for r in got) == [("a", at(0)), ("c", at(10)), ("d", at(700))], n
        assert last["stateOperators"][0]["numRowsTotal"] == 0


def plain_jobs(events, permanent, most, end):
    """A job's transitions, event by event, with every deadline met in time."""
    out = []
    for job in sorted({e[0] for e in events}):
        status, attempts, error, due, waiting = None, 0, None, 0, False
        us = lambda t: int((t - dt.datetime(1970, 1, 1)) / SECOND * 1_000_000)
        mine = sorted((us(e[4]), e[1], e[2], e[3]) for e in events if e[0] == job)
        for now, _, kind, code in [*mine, (us(end), 0, None, None)]:
            if waiting and due <= now and status in ("PROCESSING", "FAILED"):
                out.append((job, due, "LEASE_EXPIRED" if status == "PROCESSING" else "RETRY_DUE", status, attempts, error, due))
                waiting = False
            said = None
            if kind == "ENQUEUED" and status is None:
                status, due, said = "PENDING", now, kind
            elif kind == "CLAIMED" and status in ("PENDING", "FAILED", "PROCESSING") and due <= now:
                if attempts >= most:
                    status, error, due, said = "DEAD_LETTER", "RETRY_EXHAUSTED", now, "DEAD_LETTER"
                else:
                    status, error, attempts, due, waiting, said = "PROCESSING", None, attempts + 1, now + 300_000_000, True, kind
            elif kind == "FAILED" and status == "PROCESSING":
                if code in permanent or attempts >= most:
                    status, error, due, said = "DEAD_LETTER", code if code in permanent else "RETRY_EXHAUSTED", now, "DEAD_LETTER"
                else:
                    status, error, due, waiting, said = "FAILED", code, now + 300_000_000, True, kind
            elif kind == "COMPLETED" and status == "PROCESSING":
                status, said = "COMPLETED", kind
            if said:
                out.append((job, now, said, status, attempts, error, due))
            if status in ("COMPLETED", "DEAD_LETTER"):
                break
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [7, 60])
def test_leases_retries_and_dead_letters_over_time(spark, tmp_path, size):
    """The same transitions however the stream is cut, and no state left."""
    rng = random.Random(4)
    schema = "job_id string, number long, kind string, error_code string, at timestamp"
    events = [(f"j{j}", 0, "ENQUEUED", None, at(j)) for j in range(8)]
    for i in range(1, 220):
        kind = rng.choice(["CLAIMED", "CLAIMED", "FAILED", "COMPLETED"] if i > 50 else ["CLAIMED", "CLAIMED", "FAILED"])
        events.append((f"j{rng.randrange(8)}", i, kind, rng.choice(["TIMEOUT"] * 9 + ["BAD_INPUT"]) if kind == "FAILED" else None, at(40 * i)))
    end = [("z", 999, "ENQUEUED", None, at(40_000)), ("z", 1000, "CLAIMED", None, at(40_001)), ("z", 1001, "COMPLETED", None, at(40_002))]
    make = source(spark, str(tmp_path / "in"), [*cut(events, size), end[:1], end[1:2], end[2:]], schema)
    got, _, last = run(jobs.job_stream(make(), ("BAD_INPUT",), 4), "append", str(tmp_path / "cp"))
    text = lambda x: None if x is None or x != x else x
    rows = sorted(((r.job_id, r.at, r.transition, r.status, r.attempts, text(r.error_code), r.next_attempt_at) for r in got if r.job_id != "z"), key=str)
    want = plain_jobs(events, {"BAD_INPUT"}, 4, at(30_000))
    assert rows == want
    assert {"LEASE_EXPIRED", "RETRY_DUE", "DEAD_LETTER", "COMPLETED"} <= {w[2] for w in want}


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    schema = "key string, value long, seen long"
    parts = [[("a", 1, 1), ("b", 1, 1)], [("a", 2, 2), ("c", 1, 2), ("c", 3, 3)], [("b", 9, 4)]]
    path = str(tmp_path / "table")
    make = source(spark, str(tmp_path / "in"), parts, schema)
    write = sink.writer(path)

    def flaky(batch, number):
        """Dies after the rows of the second batch are written and before the ledger knows it, once."""
        if number == 1 and not died:
            died.append(number)
            batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(f"{path}/rows")
            raise RuntimeError("lost")
        write(batch, number)

    died, options = [], {"checkpointLocation": str(tmp_path / "cp")}
    start = lambda f: make().writeStream.foreachBatch(f).options(**options).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        start(flaky).awaitTermination(120)
    seen = sink.committed(spark, path, schema)
    assert sorted(tuple(r)[1:] if len(r) == 4 else tuple(r) for r in seen.select("key", "value", "seen").collect()) == [("a", 1, 1), ("b", 1, 1)]
    start(flaky).awaitTermination(120)
    rows = sink.committed(spark, path, schema)
    assert rows.count() == 6 and died == [1]
    write(spark.createDataFrame(parts[1], schema), 1)  # once more, by hand
    rows = sink.committed(spark, path, schema)
    assert rows.count() == 6
    assert {r.key: r.value for r in sink.inserted(rows, ["key"]).collect()} == {"a": 1, "b": 1, "c": 1}
    assert {r.key: r.value for r in sink.upserted(rows, ["key"], "seen").collect()} == {"a": 2, "b": 9, "c": 3}
