import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.operators import clustering as C
from sigmill.operators.shared import release, stored
from tests.plain_clustering import IncrementalGate as PlainGate
from tests.plain_clustering import arrival_clusters

SECOND = 1_000_000


def unit(degrees):
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees)), 0.0]


def gate(rows, **policy):
    """rows: (angle, second, session, submission, error)"""
    g = C.IncrementalGate(C.Policy(**({"threshold": 0.79, "min_sessions": 5} | policy)))
    for i, (angle, at, session, *rest) in enumerate(rows, 1):
        g.add(i, session, at * SECOND, unit(angle), *(rest or (None, None)))
    return g


def sizes(g):
    return sorted(len(c.members) for c in g.clusters.values())


def test_one_session_counts_once():
    g = gate([(0, 0, "a"), (0, 1, "a")], min_sessions=2)
    (c,) = g.clusters.values()
    assert (c.raw, c.sessions, c.status) == (2, 1, "CANDIDATE")


def test_structured_conflict_divides():
    assert sizes(gate([(0, 0, "a", None, "E100"), (0, 1, "b", None, "E200")])) == [1, 1]


def test_unknown_filter_takes_the_first_known_value():
    g = gate([(0, 0, "a"), (0, 1, "b", None, "E1"), (0, 2, "c", None, "E2")])
    assert sizes(g) == [1, 2]


@pytest.mark.parametrize(("cosine", "expected"), [(0.79, [2]), (0.78, [1, 1])])
def test_threshold_boundary(cosine, expected):
    assert sizes(gate([(0, 0, "a"), (math.degrees(math.acos(cosine)), 1, "b")])) == expected


def test_no_chaining():
    assert sizes(gate([(0, 0, "a"), (40, 1, "b"), (80, 2, "c")], threshold=0.7)) == [1, 2]


def test_reconciliation_merges_into_the_smaller_id():
    g = gate([(0, 0, "a"), (0, 1, "b"), (60, 2, "c"), (60, 3, "d"), (30, 4, "e")], threshold=0.58)
    (c,) = g.clusters.values()
    assert (c.id, len(c.members), c.status, c.representative) == (1, 5, "SIGNAL_DETECTED", 5)
    assert g.closed == [(3, 1)]


def test_medoid_is_central():
    (c,) = gate([(0, 0, "a"), (30, 1, "b"), (60, 2, "c")], threshold=0.45).clusters.values()
    assert c.representative == 2


@pytest.mark.parametrize(("gap", "expected"), [(600, [2]), (601, [1, 1])])
def test_window_boundary(gap, expected):
    assert sizes(gate([(0, 0, "a"), (0, gap, "b")])) == expected


def test_rolling_evidence():
    (c,) = gate([(0, 0, "a"), (0, 600, "b"), (0, 1200, "c")], min_sessions=3).clusters.values()
    assert (len(c.members), c.raw, c.sessions, c.status) == (3, 2, 2, "CANDIDATE")


def naive_agglomerate(sims, threshold):
    clusters = [[i] for i in range(len(sims))]
    while True:
        best = None
        for a in clusters:
            for b in clusters:
                if a < b:
                    score = np.mean([sims[i][j] for i in a for j in b])
                    if score >= threshold and (best is None or (-round(score, 9), a, b) < best):
                        best = (-round(score, 9), a, b)
        if best is None:
            return sorted(clusters)
        clusters = sorted([c for c in clusters if c not in best[1:]] + [sorted(best[1] + best[2])])


def test_agglomeration_equals_the_plain_form():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sims = C.similarities(rng.standard_normal((14, 4)))
        assert C.agglomerate(sims, 0.3) == naive_agglomerate(sims, 0.3)


def test_batch_clusters_do_not_depend_on_order(spark):
    rows = [("A", i, v) for i, v in enumerate([[1.0, 0.0], [0.866, 0.5], [0.5, 0.866], [0.0, 0.0]])] + [("UNKNOWN", 9, [1.0, 0.0]), ("UNKNOWN", 10, [1.0, 0.0])]
    seen = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        out = C.batch_clusters(spark.createDataFrame(rows, "issue_type string, report_id long, vec array<double>")).collect()
        seen.add(tuple(sorted((r.report_id, r.representative_id) for r in out)))
    assert len(seen) == 1
    assert dict(seen.pop())[10] == 10


def reports(spark, n=120, seed=5):
    rng = random.Random(seed)
    rows = [
        ("T", i, rng.randrange(8), rng.randrange(0, 40_000) * SECOND, unit(rng.choice([0, 20, 60, 90, 130])), rng.choice(["SUBMITTED", "UNKNOWN"]), rng.choice([None, "E1", "E2"]))
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "issue_type string, report_id long, session_id long, at long, vec array<double>, submission_status string, error_code string")
    return df.withColumn("received_at", F.timestamp_micros("at")).drop("at"), rows


def test_islands_do_not_change_clusters(spark):
    df, rows = reports(spark)
    policy = C.Policy(threshold=0.7, min_sessions=2)
    found = {(r.signal_id, r.report_id) for r in C.online_clusters(df, policy, ["issue_type"]).collect()}
    g = C.IncrementalGate(policy)
    for r in sorted(rows, key=lambda r: (r[3], r[1])):
        g.add(r[1], r[2], r[3], r[4], None if r[5] == "UNKNOWN" else r[5], r[6])
    assert found == {(c.id, m[0]) for c in g.clusters.values() for m in c.members}


def test_stream_agrees_with_batch(spark, tmp_path):
    from sigmill.streaming.online import online_stream

    df, _ = reports(spark, 60)
    policy = C.Policy(threshold=0.7, min_sessions=2)
    df.orderBy("received_at", "report_id").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = online_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), policy, ["issue_type"])
    query = stream.writeStream.format("memory").queryName("online").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.signal_id, r.report_id) for r in spark.table("online").collect()}
    assert got == {(r.signal_id, r.report_id) for r in C.online_clusters(df, policy, ["issue_type"]).collect()}


def test_order_stability_and_greedy(spark):
    rows = [("T", i, unit(a)) for i, a in enumerate([0, 10, 20, 70, 80, 90])]
    df = spark.createDataFrame(rows, "issue_type string, report_id long, vec array<double>")
    assert {r.clusters for r in C.order_stability(df, 0.8, 4, True).collect()} == {2}
    assert len({r.representative_id for r in C.medoid_greedy(df, 0.9).collect()}) == 2
    assert len({r.representative_id for r in C.complete_link(df, 0.9).collect()}) == 2


def state(clusters):
    out = []
    for c in clusters:
        members = sorted((m[0], round(m[4], 9)) for m in c.members)
        out.append((c.id, members, c.status, c.raw, c.sessions, c.first, c.last, c.representative, c.submission, c.error))
    return sorted(out)


@pytest.mark.parametrize("seed", range(12))
def test_gate_equals_the_plain_form(seed):
    """Dense and sparse, few and many directions, with and without single_max; with copies of vectors and zero vectors."""
    rng = random.Random(seed)
    policy = C.Policy(window=rng.choice([50, 600]), threshold=rng.choice([0.5, 0.8]), min_sessions=2, single_max=seed % 4 == 3)
    fast, plain = C.IncrementalGate(policy), PlainGate(policy)
    base = [np.array([rng.gauss(0, 1) for _ in range(4)]) for _ in range(6)] + [np.zeros(4)]
    at, gone = 0, []
    for i in range(700):
        at += rng.choice([0, 1, 1, 3, 40]) * SECOND
        vector = rng.choice(base) + np.array([rng.gauss(0, 0.2) * rng.choice([0, 1]) for _ in range(4)])
        row = (i * 7919 % 1000, rng.randrange(9), at, vector, rng.choice([None, "S", "N"]), rng.choice([None, None, "E1", "E2"]))
        assert fast.add(*row) == plain.add(*row)
        if i % 100 == 99:
            gone += fast.passed()
    assert state([*gone, *fast.clusters.values()]) == state(plain.clusters.values())
    assert fast.closed == plain.closed
    assert seed != 0 or len(gone) > 10


def test_a_report_costs_no_comparison_of_all_open_clusters():
    """Where no clusters are close, a report looks at them once, to join one, and not again to merge them."""
    gate, looked = C.IncrementalGate(C.Policy(window=3600, threshold=0.9, min_sessions=2)), []
    view = gate._view
    gate._view = lambda at: looked.append(at) or view(at)
    for i in range(64):
        gate.add(i, i, i * SECOND, np.eye(64)[i])
    assert len(gate.clusters) == len(looked) == 64


@pytest.mark.parametrize("seed", range(6))
def test_late_reports_equal_the_plain_form(seed):
    rng = random.Random(100 + seed)
    policy = C.Policy(window=100, threshold=0.7, min_sessions=2)
    fast, plain = C.IncrementalGate(policy, lateness=10_000), PlainGate(policy)
    for i in range(250):
        at = (i * 4 - rng.choice([0, 0, 0, 30, 150, 400])) * SECOND
        row = (i, rng.randrange(5), at, unit(rng.choice([0, 20, 60, 90, 130]) + rng.random()), rng.choice([None, "S"]), None)
        assert fast.add(*row) == plain.add(*row)
    assert state(fast.clusters.values()) == state(plain.clusters.values())


def parted(rows):
    parts = {}
    for r in rows:
        parts.setdefault((r.issue_type, r.representative_id), []).append((r.report_id, round(r.similarity, 9)))
    return sorted((k, sorted(v)) for k, v in parts.items())


def vectors(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((8, 6))
    rows = [("A" if i % 3 else "B", i, [float(x) for x in (base[i % 8] + rng.standard_normal(6) * (0.0 if i % 5 == 0 else 0.5))]) for i in range(n)]
    return spark.createDataFrame([*rows, ("A", 900, [0.0] * 6), ("A", 901, [0.0] * 6)], "issue_type string, report_id long, vec array<double>")


@pytest.mark.parametrize("cluster", [C.batch_clusters, C.complete_link, C.medoid_greedy])
def test_rounds_over_large_types_equal_one_task(spark, cluster):
    df = vectors(spark)
    assert parted(cluster(df, 0.55, 6).collect()) == parted(cluster(df, 0.55).collect())


def test_batch_clusters_equal_the_plain_form(spark):
    df = vectors(spark)
    rows = [r for r in df.collect() if r.issue_type == "A"]
    sims = C.similarities([r.vec for r in rows])
    want = sorted(sorted(rows[i].report_id for i in c) for c in naive_agglomerate(sims, 0.55))
    got = parted(r for r in C.batch_clusters(df, 0.55, 6).collect() if r.issue_type == "A")
    assert sorted(sorted(i for i, _ in members) for _, members in got) == want


@pytest.mark.parametrize("small", [25])
def test_complete_link_of_a_large_type_equals_one_task(spark, small):
    """Also where the clusters that rounds leave are few enough for a task: they are not merged by one vector each."""
    df = vectors(spark)
    assert parted(C.complete_link(df, 0.3, small).collect()) == parted(C.complete_link(df, 0.3).collect())


@pytest.mark.parametrize(("width", "threshold"), [(6, 0.55), (64, 0.2), (3, 0.9)])
def test_complete_link_needs_no_matrix_and_no_pairs(monkeypatch, width, threshold):
    """Also where a cluster is longer than the vectors of a step, and from clusters that are there."""
    monkeypatch.setattr(C, "STEP", 16)
    rng = np.random.default_rng(3)
    units = rng.standard_normal((500, width))
    units[5], units[40:80] = units[9], units[3]
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    want = sorted(map(sorted, C.agglomerate(units @ units.T, threshold, "complete")))
    assert sorted(map(sorted, C.complete_link_in_task(units, threshold, 10))) == want
    begun = np.arange(500)
    begun[want[0]] = want[0][0]
    own = C.complete_rounds(units, threshold, begun)
    assert sorted(sorted(np.flatnonzero(own == c).tolist()) for c in np.unique(own)) == want


def test_the_estimated_size_of_a_round_does_not_grow_with_rounds(spark):
    """Joins multiply estimates; a round that inherits them makes numbers that fill the driver."""
    df = spark.range(4).toDF("k")
    for _ in range(3):
        df = stored(df.join(df.hint("merge"), "k").join(df, "k"))
    assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 20
    assert sorted(r.k for r in df.collect()) == [0, 1, 2, 3]
    release(df)


def test_a_report_compares_only_clusters_that_changed(monkeypatch):
    """Merges come as of a comparison of all pairs, which is hardly ever made, also with filters and scores at the threshold."""
    rng = np.random.default_rng(11)
    base = rng.standard_normal((12, 16))
    kinds, codes = [None, "SUBMITTED", "NOT_SUBMITTED"], [None, "E1", "E2"]
    settled = []
    settle = C.IncrementalGate._settle
    monkeypatch.setattr(C.IncrementalGate, "_settle", lambda self, *a: settled.append(a) or settle(self, *a))
    for threshold in (0.2, 0.5):
        policy = C.Policy(window=60, threshold=threshold, min_sessions=2, review_sessions=3)
        ours, plain, n = C.IncrementalGate(policy), PlainGate(policy), 240
        for i in range(n):
            vec = base[rng.integers(12)] + 0.8 * rng.standard_normal(16)
            row = (i, int(rng.integers(9)), i * 2_000_000, vec, kinds[rng.integers(3)], codes[rng.integers(3)])
            ours.add(*row)
            plain.add(*row)
        assert ours.closed == plain.closed
        assert len(ours.closed) > 5
        assert {c.id: sorted(m[0] for m in c.members) for c in ours.clusters.values()} == {c.id: sorted(m[0] for m in c.members) for c in plain.clusters.values()}
    assert len(settled) < 10


def test_large_types_are_clustered_in_a_task_without_a_matrix():
    rng = np.random.default_rng(8)
    units = rng.standard_normal((1_500, 6))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    sizes = rng.integers(1, 4, len(units)).astype(float)
    want = C.agglomerate(units @ units.T, 0.8, sizes=sizes)
    for small in (1, 700, 2_000):
        assert C.average_link(units * sizes[:, None], sizes, 0.8, small) == want


def test_agglomeration_of_two_thousand_takes_seconds():
    import time

    rng = np.random.default_rng(9)
    units = rng.standard_normal((2_048, 16))
    began = time.perf_counter()
    for linkage in ("average", "complete"):
        C.agglomerate(C.similarities(units), 0.2, linkage)
    assert time.perf_counter() - began < 20


def test_greedy_medoids_of_a_large_type_take_one_task(spark):
    """A type over SMALL needs no round a medoid: two thousand medoids and more are found at once, as the plain form finds them."""
    rng = np.random.default_rng(4)
    units = rng.standard_normal((C.SMALL + 300, 8))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    df = spark.createDataFrame([("A", i, v.tolist()) for i, v in enumerate(units)], "issue_type string, report_id long, vec array<double>")
    got = {}
    for r in C.medoid_greedy(df, 0.9999).collect():
        got.setdefault(r.representative_id, []).append(r.report_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, C.greedy_medoids(units, 0.9999)))


@pytest.mark.parametrize("merging", [False, True])
def test_arrival_orders_equal_the_plain_form(spark, merging):
    df = vectors(spark, 90)
    rows = sorted((r.report_id, r.vec) for r in df.collect() if r.issue_type == "A")
    sims = C.similarities([v for _, v in rows])
    got = {}
    for r in C.arrivals(df, 0.5, 3, merging).filter("issue_type = 'A'").collect():
        got.setdefault(r.order_id, {}).setdefault(r.cluster, set()).add(r.report_id)
    n = len(rows)
    for number, order in enumerate((range(n), range(n - 1, -1, -1))):
        want = arrival_clusters(sims, list(order), 0.5, merging)
        assert sorted(map(sorted, got[number].values())) == sorted(sorted(rows[i][0] for i in c) for c in want)
    assert sum(map(len, got[2].values())) == n


def test_stream_emits_changes_only(spark, tmp_path):
    from sigmill.streaming.online import online_stream

    df, _ = reports(spark, 80)
    policy = C.Policy(threshold=0.7, min_sessions=2)
    ordered = df.orderBy("received_at", "report_id").collect()
    for i in range(4):
        part = spark.createDataFrame(ordered[20 * i : 20 * i + 20], df.schema)
        if i == 3:
            part = part.unionByName(part.limit(3)).unionByName(spark.createDataFrame([(*ordered[0][:1], None, *ordered[0][2:])], df.schema))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = online_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), policy, ["issue_type"])
    seen = []
    query = stream.writeStream.foreachBatch(lambda b, i: seen.append(b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    last = {}
    for batch in seen:
        closed = {r.signal_id for r in batch if r.status == "CLOSED"}
        last = {k: v for k, v in last.items() if v[0] not in closed}
        last.update({r.report_id: (r.signal_id, r.raw_report_count, r.representative_id) for r in batch if r.report_id is not None})
    want = {r.report_id: (r.signal_id, r.raw_report_count, r.representative_id) for r in C.online_clusters(df, policy, ["issue_type"]).collect()}
    assert last == want
    assert sum(map(len, seen)) < len(seen) * len(want)


def _groups(rng, n, noise):
    """Vectors around a few centres, some so near that centres chain into one part."""
    import numpy as np

    centres = rng.normal(size=(8, 12))
    vecs = centres[rng.integers(0, 8, n)] + noise * rng.normal(size=(n, 12))
    return vecs / np.linalg.norm(vecs, axis=1, keepdims=True)


@pytest.mark.parametrize("block", [7, 1024])
def test_threshold_parts_equal_a_plain_search(spark, monkeypatch, block):
    import numpy as np

    monkeypatch.setattr("sigmill.operators.blocks.BLOCK", block)
    monkeypatch.setattr("sigmill.operators.blocks.placed.__defaults__", (block, ("block", "blocks")))
    monkeypatch.setattr("sigmill.operators.blocks.pairwise.__defaults__", (block,))
    vecs = _groups(np.random.default_rng(block), 90, 0.35)
    vecs[5] = 0
    types = ["AB"[i % 2] for i in range(90)]
    df = spark.createDataFrame([(t, i, v.tolist()) for i, (t, v) in enumerate(zip(types, vecs, strict=True))], "issue_type string, report_id long, vec array<double>")
    near = (vecs @ vecs.T >= 0.8) & np.array([[a == b for b in types] for a in types])
    want = {}
    for i in range(90):
        part, front = {i}, [i]
        while front:
            new = set(np.flatnonzero(near[front.pop()]).tolist()) - part
            part |= new
            front += new
        if len(part) > 1:
            want[i] = min(part)
    got = {r.report_id: r.part for r in C.threshold_parts(df, ["issue_type"], 0.8).collect()}
    assert got == want and 1 < len(set(want.values())) < 40
    sizes = {r.issue_type: (r.reports, r.largest) for r in C.part_sizes(df, C.threshold_parts(df, ["issue_type"], 0.8)).collect()}
    for t in "AB":
        of = [want.get(i, i) for i in range(90) if types[i] == t]
        assert sizes[t] == (45, max(map(of.count, of)))


@pytest.mark.parametrize("merging", [False, True])
def test_arrivals_by_parts_equal_the_fold_of_the_whole_type(spark, merging):
    """All twelve orders, against one part for each type, which is the fold over everything."""
    import numpy as np

    vecs = _groups(np.random.default_rng(3), 150, 0.3)
    df = spark.createDataFrame([("A" if i < 110 else "B", i, v.tolist()) for i, v in enumerate(vecs)], "issue_type string, report_id long, vec array<double>")
    whole = df.select("report_id", F.when(F.col("issue_type") == "A", 0).otherwise(110).cast("long").alias("part"))
    key = lambda rows: sorted(map(tuple, rows))
    split = C.arrivals(df, 0.8, 12, merging).collect()
    assert key(split) == key(C.arrivals(df, 0.8, 12, merging, whole).collect()) and len(split) == 12 * 150
    parts = C.threshold_parts(df, ["issue_type"], 0.8)
    assert C.part_sizes(df, parts).filter("largest < reports AND parts > 1").count() == 2
