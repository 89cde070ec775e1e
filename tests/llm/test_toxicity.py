import random

import numpy as np
from pyspark.sql import functions as F

from sigmill.llm import toxicity as T

DOCS = "doc_id long, text string, score string, toxic string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600, seed=4):
    rng = random.Random(seed)
    plain = [a + b for a in ("ka", "lo", "mi", "ra", "su", "te") for b in ("na", "po", "ri", "sa", "to", "vu")]
    docs, labels = [], []
    for i in range(n):
        said = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(12)]
        bad = i % 5 == 0
        if bad:
            k = rng.randrange(12)
            said[k] = f"you {rng.choice(['brute', 'fool', 'swine'])} " + said[k]
        docs.append((i, ". ".join(said) + ".", "s", "t"))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_learns_words_from_document_labels(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, DOCS)
    extra = [(5, None, None), (None, 1, 1), (9999, 1, 1)]
    model = T.fit(frame, spark.createDataFrame([*labels, *extra], LABELS), steps=40)
    scores = {r.doc_id: r.score for r in T.score(frame, model).collect()}
    assert all((scores[i] >= T.THRESHOLD) == bool(t) for i, _, t in labels)
    found = T.locate(frame, model).collect()
    assert {r.doc_id for r in found} == {i for i, _, t in labels if t}
    assert all(any(w in r.sentence for w in ("brute", "fool", "swine")) for r in found)
    texts = {d[0]: d[1] for d in docs}
    assert all(texts[r.doc_id][r.start : r.end] == r.sentence for r in found)
    kept = T.keep_clean(frame, model)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, _, t in labels if not t}
    again = T.fit(frame, spark.createDataFrame(labels, LABELS), steps=40)
    assert np.isclose(model.bias, again.bias) and model.weights.keys() == again.weights.keys()


def test_only_the_training_rows_teach(spark):
    docs, labels = corpus(300)
    frame = spark.createDataFrame(docs, DOCS)
    import zlib

    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    one = T.fit(frame, spark.createDataFrame(labels, LABELS), steps=5)
    two = T.fit(frame, spark.createDataFrame(flipped, LABELS), steps=5)
    assert one == two


def test_edges(spark):
    model = T.Model(-3.0, {T.bucket(b"bad"): 6.0})
    rows = [(1, None, "a", "b"), (2, "", "a", "b"), (3, "BAD!", "a", "b"), (3, "BAD!", "a", "b"), (None, "good. " * 5000, "a", "b"), (4, "\n.\n", "a", "b")]
    got = [(r.doc_id, round(r.score, 6)) for r in T.score(spark.createDataFrame(rows, DOCS), model).collect()]
    empty = round(1 / (1 + np.exp(3.0)), 6)
    assert got.count((3, round(1 / (1 + np.exp(-3.0)), 6))) == 2 and (1, empty) in got and (2, empty) in got and (4, empty) in got
    assert next(s for i, s in got if i is None) > 0.99
    none = spark.createDataFrame([], DOCS)
    assert T.score(none, model).count() == 0
    untaught = T.fit(none, spark.createDataFrame([], LABELS))
    assert untaught.weights == {} and np.isclose(T.Scorer(untaught).document(b""), 1 / (1 + 2**20))
    assert T.locate(spark.createDataFrame(rows, DOCS), model, 0.9).count() == 2


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    sizes = [np.array([2, 0, 3]), np.array([1])]
    ids = np.array([0, 1, 2, 3, 1, 2])
    toxic = np.array([1, 0])
    w, b = rng.standard_normal(4), -1.0

    def loss(w, b):
        z = [b + w[[0, 1]].sum(), b, b + w[[2, 3, 1]].sum(), b + w[2]]
        p = 1 / (1 + np.exp(-np.array(z)))
        one = 1 - np.prod(1 - p[:3])
        return -np.log(one) - np.log(1 - p[3])

    db, dw = T.bag_gradient(w, b, toxic, sizes, ids)
    eps = 1e-6
    assert np.isclose(db, (loss(w, b + eps) - loss(w, b - eps)) / (2 * eps), atol=1e-5)
    for k in range(4):
        step = np.eye(4)[k] * eps
        assert np.isclose(dw[k], (loss(w + step, b) - loss(w - step, b)) / (2 * eps), atol=1e-5)


def test_labels_count_once(spark):
    docs = spark.createDataFrame([(i, "a b", "x", "y") for i in range(9)], DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9)] + [(4, 1, 1)], LABELS)
    rows = T.training_rows(docs, labels)
    assert rows.count() <= 9 and rows.agg(F.sum("toxic")).first()[0] in (0, 1)
