"""Retention, queues, rate limits and the symbol master."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sigmill.operators import lifecycle as L
from sigmill.operators import metrics, symbols
from sigmill.sources import proxies
from sigmill.streaming import jobs, online

NOW = dt.datetime(2026, 8, 29, 3, 0, 0)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_purge_is_inclusive(spark):
    gaps = [dt.timedelta(microseconds=-1), dt.timedelta(0), dt.timedelta(microseconds=1)]
    rows = spark.createDataFrame([(i, NOW + g) for i, g in enumerate(gaps)], "report_id long, purge_at timestamp_ntz")
    kept = L.purge(rows, {"cards": rows.select("report_id")}, now())
    assert [r.report_id for r in kept["reports"].collect()] == [2] and [r.report_id for r in kept["cards"].collect()] == [2]
    assert L.purge(kept["reports"], {}, now())["reports"].count() == 1
    assert one(spark, L.is_accessible(now(), now())) is False


@pytest.mark.parametrize(("attempts", "delay"), [(1, 60), (2, 120), (6, 1920), (7, 3600), (40, 3600)])
def test_backoff(spark, attempts, delay):
    assert one(spark, L.retry_delay(F.lit(attempts))) == delay


def test_failures_end_in_the_dead_letters(spark):
    first = one(spark, L.failed_job(F.lit(1), F.lit("PROVIDER"), F.lit(False), now(), 2))
    last = one(spark, L.failed_job(F.lit(2), F.lit("PROVIDER"), F.lit(False), now(), 2))
    permanent = one(spark, L.failed_job(F.lit(1), F.lit("CONTRACT"), F.lit(True), now(), 2))
    assert tuple(first) == ("FAILED", "PROVIDER", NOW + dt.timedelta(minutes=5))
    assert tuple(last) == ("DEAD_LETTER", "RETRY_EXHAUSTED", NOW) and tuple(permanent) == ("DEAD_LETTER", "CONTRACT", NOW)


def test_rate_limit(spark):
    hits = spark.createDataFrame([("b", i, 0.0) for i in range(5)] + [("b", 9, 60.0), ("c", 10, 3.0)], "bucket string, hit_id long, at double")
    out = {r.hit_id: r.allowed for r in L.rate_limit(hits, 60, 2).collect()}
    assert out == {0: True, 1: True, 2: False, 3: False, 4: False, 9: True, 10: True}
    assert one(spark, L.retry_after(now() + F.expr("INTERVAL 60 SECONDS"), now())) == 60
    assert one(spark, L.retry_after(now(), now())) == 1


def test_rate_limit_stream(spark, tmp_path):
    hits = spark.createDataFrame([("b", i, float(i)) for i in range(6)], "bucket string, hit_id long, at double")
    hits.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.rate_limit_stream(spark.readStream.schema(hits.schema).parquet(str(tmp_path / "in")), 3, 2)
    query = stream.writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {(r.hit_id, r.allowed, r.hit_number) for r in L.rate_limit(hits, 3, 2).collect()}
    assert {(r.hit_id, r.allowed, r.hit_number) for r in spark.table("limits").collect()} == want


def test_hourly_stream_and_single_delivery(spark, sf_dir, tmp_path):
    rows = proxies.reports(spark, sf_dir).select("report_id", F.col("received_at").cast("timestamp").alias("received_at"))
    rows.unionByName(rows).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("hourly", online.hourly_stream(source), "complete"), ("once", online.once_only(source), "append")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(180)
    assert spark.table("hourly").agg(F.sum("raw_report_count")).first()[0] == 2 * rows.count()
    assert spark.table("once").count() == rows.count()


def test_idempotency_and_upserts(spark):
    asked = spark.createDataFrame([(1, "k", "a"), (2, "k", "a"), (3, "k", "b"), (4, "m", "b")], "request_id long, key string, payload_sha256 string")
    assert [r.outcome for r in L.idempotency(asked).orderBy("request_id").collect()] == ["NEW", "REPLAY", "CONFLICT", "NEW"]
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "x"), (3, "z"), (3, "y")], "id long, v string")
    assert sorted(map(tuple, L.insert_ignore(old, new, ["id"]).collect())) == [(1, "a"), (2, "b"), (3, "y")]
    assert sorted(map(tuple, L.upsert(old, new.filter("id = 2"), ["id"]).collect())) == [(1, "a"), (2, "x")]


def test_requeue_twice(spark):
    later = NOW + dt.timedelta(hours=1)
    rows = spark.createDataFrame([(i, NOW, later, "CONFIRMED", "t") for i in range(2)], "report_id long, received_at timestamp_ntz, purge_at timestamp_ntz, status string, taxonomy_version string")
    old = spark.createDataFrame([(0, "P0"), (1, "P0")], "report_id long, policy_id string")
    assert [r.action for r in L.requeue(rows, old, F.lit("P1"), F.lit("t"), now(), 10).collect()] == ["RESET"] * 2
    assert L.requeue(rows, old.withColumn("policy_id", F.lit("P1")), F.lit("P1"), F.lit("t"), now(), 10).count() == 0
    assert L.requeue(rows, old.filter("false"), F.lit("P1"), F.lit("t"), now(), 1).count() == 1


def test_alerts(spark):
    assert one(spark, L.alerts(*[F.lit(0)] * 4)) == []
    assert one(spark, L.alerts(*[F.lit(1)] * 4)) == ["SIGNAL_JOB_REPEATED_FAILURE", "SIGNAL_JOB_DEAD_LETTER", "AI_PROVIDER_FAILURE", "OBJECT_DELETION_RETRY"]


def test_symbols_over_three_dates(spark):
    names = spark.createDataFrame([(f"{i:06d}", f"n{i}", "KOSPI") for i in range(100)], "code string, name string, market string")
    active = names.select("code", F.lit(None).cast("date").alias("last_seen_on"), F.lit(None).cast("date").alias("missing_since"))
    short = names.filter("code <> '000007'").unionByName(spark.createDataFrame([("X00001", "x", "KOSPI")], names.schema))

    def step(active, listed, day):
        out = symbols.reconcile(names, active, listed, F.to_date(F.lit(day)))
        return symbols.next_active(out), {r.outcome: r["count"] for r in out.groupBy("outcome").count().collect()}

    active, counts = step(active, short, "2026-08-01")
    assert counts == {"SEEN": 99, "PENDING": 1}
    again, counts = step(active, short, "2026-08-01")
    assert counts == {"SEEN": 99, "PENDING": 1}
    active, counts = step(active, short, "2026-08-02")
    assert counts == {"SEEN": 99, "REMOVED": 1} and active.count() == 99
    active, counts = step(active, names, "2026-08-03")
    assert counts == {"SEEN": 100} and active.count() == 100
    assert symbols.verify(names, short).first().ok and symbols.verify(names, short).first().unknown_listed == 1
    assert not symbols.verify(names, names.limit(50)).first().ok


def test_symbol_validation(spark):
    master = spark.createDataFrame([("000001", "one", "KOSPI")], "code string, name string, market string")
    asked = spark.createDataFrame([(1, None, "x"), (2, "UNKNOWN", "x"), (3, "000002", None), (4, "000001", "two"), (5, "000001", None), (6, "000001", "one")], "request_id long, symbol_code string, symbol_name string")
    out = {r.request_id: r.result for r in symbols.validate(asked, master).collect()}
    assert out == {1: None, 2: None, 3: "UNSUPPORTED", 4: "MISMATCH", 5: "MATCHED", 6: "MATCHED"}


def test_threshold_metrics(spark):
    pairs = spark.createDataFrame([(0.9, True), (0.8, False), (0.56, True), (0.1, False), (0.1, True)], "similarity double, same boolean")
    rows = {round(r.threshold, 2): r for r in metrics.threshold_counts(pairs, 50, 95).collect()}
    assert (rows[0.56].tp, rows[0.56].fp, rows[0.56].fn, rows[0.56].tn) == (2, 1, 1, 1) and rows[0.57].tp == 1
    assert rows[0.95].precision == 0 and rows[0.95].f1 == 0
    assert round(metrics.select_threshold(metrics.threshold_counts(pairs, 50, 95)).first().threshold, 2) == 0.9
