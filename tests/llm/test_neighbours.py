import numpy as np
import pytest

from sigmill.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, score double, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1.0, 1) for i, v in rows], SCHEMA)


def search(df, **more):
    return N.search(df, lambda i: i % 10 == 0, **more).collect()


def brute(rows, k=5):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q in ok:
        if q % 10 == 0:
            found = sorted((-float(ok[q] @ ok[i] / np.sqrt(ok[q] @ ok[q]) / np.sqrt(ok[i] @ ok[i])), i) for i in ok if i != q)
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def test_recall_on_random_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(32).tolist()) for i in range(1500)]
    got = search(frame(spark, rows))
    want = brute(rows)
    pairs = {(r.query_id, r.vec_id) for r in got}
    truth = {(q, i) for q, found in want.items() for i, _ in found}
    assert len(pairs & truth) / len(truth) >= 0.9
    vec = dict(rows)
    for r in got[:50]:
        a, b = (np.array(vec[x], np.float32).astype(float) for x in (r.query_id, r.vec_id))
        assert abs(r.score - a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) < 1e-12
    assert sorted(r["rank"] for r in got) == sorted(list(range(1, 6)) * 150)


def recall(spark, df, share):
    """The share of the true five nearest that are found, for the queries whose ids `share` divides, and the largest error of a score."""
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    ids, vec = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    place = {int(x): k for k, x in enumerate(ids)}
    hits = wanted = error = 0
    got = {}
    for r in N.search(df, lambda i: i % share == 0).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        error = max(error, abs(r.score - unit[place[r.query_id]] @ unit[place[r.vec_id]]))
    for q in ids[ids % share == 0].tolist():
        scores = unit @ unit[place[q]]
        scores[place[q]] = -2
        hits += len({*ids[np.lexsort((ids, -scores))[:5]].tolist()} & {*got[q]})
        wanted += 5
    return hits / wanted, error


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_embeddings(spark, sf):
    found, error = recall(spark, spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet"), 50)
    assert found >= 0.9 and error < 1e-12


def test_recall_on_fifty_thousand_rows(spark):
    rng = np.random.default_rng(6)
    rows = rng.standard_normal((50_000, 64)).astype(np.float32)
    df = spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id long, embedding array<float>")
    found, error = recall(spark, df, 250)
    assert found >= 0.9 and error < 1e-12


def test_copies_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(2)
    common = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, common) for i in range(200)] + [(i, rng.standard_normal(4).tolist()) for i in range(200, 260)]
    rows += [(300, None), (310, [0, 0, 0, 0]), (320, [1, None, 1, 1]), (330, [float("nan"), 1, 1, 1]), (340, [float("inf"), 1, 1, 1]), (None, common), (0, common), (350, [2.0, 1.0])]
    rows_ok = [r for r in rows if r[0] != 350]
    got = {}
    for r in search(frame(spark, rows)):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows_ok)
    assert got.keys() == want.keys()
    for q in range(0, 200, 10):
        assert [i for _, i, _ in sorted(got[q])] == [i for i, _ in want[q]]


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_few_rows_are_all_returned(spark, n):
    rows = [(10 * i, [1.0, float(i), -float(i * i)]) for i in range(n)]
    got = search(frame(spark, rows))
    assert len(got) == n * (n - 1)
    for q, found in brute(rows).items():
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [i for i, _ in found]


def test_probes_come_in_order_of_chance():
    rng = np.random.default_rng(3)
    unit = rng.standard_normal((5, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    shape = N.projections(8, 3, 0)
    rows, keys, reached = N.probes(unit, *shape)
    assert reached.all() and not N.probes(unit, *shape, success=1.1)[2].any()
    own = N.buckets(unit, *shape)
    for q in range(5):
        assert keys[rows == q][0] == own[q]
        assert len(set(keys[rows == q])) == (rows == q).sum() > 1


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = frame(spark, [(i, rng.standard_normal(8).tolist()) for i in range(300)])
    whole = sorted(map(str, search(df)))
    monkeypatch.setattr(N, "CANDIDATE_BLOCK", 7)
    monkeypatch.setattr(N, "QUERY_BLOCK", 3)
    assert sorted(map(str, search(df))) == whole
