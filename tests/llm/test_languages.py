import random
import re
import zlib

import numpy as np

from sigmill.llm import languages as L

DOCS = "doc_id long, text string, lang string, score double"
SYLLABLES = {"xx": ["ka", "to", "mi", "ru", "nesh"], "yy": ["schr", "ung", "öl", "zei", "bert"], "zz": ["ção", "nho", "vel", "qui", "lha"]}


def say(rng, lang, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(n=300):
    rng = random.Random(1)
    return [(i, say(rng, lang, rng.randrange(5, 60)).capitalize(), lang, 0.0) for i in range(n) for lang in [list(SYLLABLES)[i % 3]]]


def test_held_out_accuracy(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in L.predict(df, *L.fit(df)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _ in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_mixtures_are_seen(spark):
    rng = random.Random(2)
    df = spark.createDataFrame(corpus(), DOCS)
    mixed = [(1000 + i, say(rng, "xx", 60) + " " + say(rng, "yy", 25), None, 0.0) for i in range(10)]
    got = L.predict(spark.createDataFrame(mixed, DOCS), *L.fit(df)).collect()
    assert {r.lang_pred for r in got} == {"xx"} and {r.n_langs for r in got} == {2}
    assert all(0.55 < r.score < 0.85 for r in got)


def test_only_training_rows_teach(spark):
    rows = corpus(150)
    other = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang, s) for i, t, lang, s in rows] + [(None, "schrung", "xx", 0.0), (3000, "to", None, 0.0)]
    one, two = (L.fit(spark.createDataFrame(r, DOCS)) for r in (rows, other))
    assert one[0] == two[0]
    tables = [L.Likelihoods(*m[1]).table for m in (one, two)]
    assert np.array_equal(*tables)


def test_edges(spark):
    df = spark.createDataFrame(corpus(), DOCS)
    model = L.fit(df)
    rng = random.Random(3)
    long = say(rng, "zz", 300_000)
    rows = [(1, None), (2, ""), (3, "12 345 ... !!"), (4, "ka"), (4, "ka"), (None, "ungzei schr"), (5, "— «»"), (6, long), (7, "日本語")]
    got = L.predict(spark.createDataFrame([(i, t, None, 0.0) for i, t in rows], DOCS), *model).collect()
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert len(got) == len(rows) and by[1] == by[2] == by[3] == by[5] == ("und", 0.0)
    assert by[4][0] == "xx" and by[None][0] == "yy" and by[6][0] == "zz" and by[7][0] in model[0]
    none = L.fit(df.filter("false"))
    assert none[0] == [] and {r.lang_pred for r in L.predict(df, *none).collect()} == {"und"}
    assert L.predict(df.filter("false"), *model).count() == 0


def test_pieces_and_trigrams():
    text = ("añb " * 700_000).encode()
    assert b"".join(L.pieces(text)) == text and len(L.pieces(text)) > 1
    hashed, sizes, words = L.trigrams([b"Ab c", b"", b"1 2", b"ab"])
    assert words.tolist() == [2, 0, 0, 1] and sizes.tolist() == [3, 2, 3]
    assert hashed[:3].tolist() == hashed[5:].tolist()
    upper, lower = (L.trigrams([t.encode()])[0].tolist() for t in ("ÉCOLE", "école"))
    assert upper == lower


def test_em_matches_a_plain_loop():
    rng = np.random.default_rng(1)
    scores, words = rng.standard_normal((9, 3)).astype(np.float32), np.array([4, 5])
    share, likelihood = L._mixture(scores, words, np.ones((2, 3)))
    for t, rows in ((0, scores[:4]), (1, scores[4:])):
        p = np.full(3, 1 / 3)
        for _ in range(L.ROUNDS):
            r = np.exp(rows) * p
            p = (r / r.sum(1, keepdims=True)).mean(0)
        assert np.allclose(share[t], p, atol=1e-4)
        assert np.isclose(likelihood[t], np.log((np.exp(rows) * p).sum(1)).sum(), atol=1e-3)


def test_many_languages_are_held_as_seen_cells(spark):
    """More languages than fit a full table, with the same results as the full one."""
    rng = random.Random(4)
    rows = corpus(120) + [(2000 + i, say(rng, "xx", 8), f"dirty{i}", 0.0) for i in range(200)] + [(2500, "!!", "nothing", 0.0), (2501, "!!", "nothing", 0.0)]
    df = spark.createDataFrame(rows, DOCS)
    sparse, dense = L.fit(df), L.fit(df, 1000)
    assert not sparse[1][2] and dense[1][2] and len(sparse[0]) > L.MAX_DENSE and "nothing" in sparse[0]
    key = lambda m: sorted((str(r.doc_id), r.lang_pred, round(r.score, 4), r.n_langs) for r in L.predict(df, *m).collect())
    assert key(sparse) == key(dense)


def plain(text, names, logs):
    """(language, score, languages) of a text by loops; logs: (bucket, language) log-probabilities."""
    words = []
    for raw in re.findall(rb"[a-z\x80-\xff]+", lowered(text)):
        w = b" " + raw + b" "
        first = [b" " + w[:2], *(w[i : i + 3] for i in range(len(w) - 2))]
        buckets = [((x[0] << 16 | x[1] << 8 | x[2]) * 2654435761 % 2**32) >> 16 for x in first]
        words.append(sum(logs[b].astype(float) for b in buckets))
    words = np.array(words)

    def mixed(allowed):
        p = np.array(allowed, float) / sum(allowed)
        for _ in range(L.ROUNDS):
            r = np.exp(words - words.max(1, keepdims=True)) * p
            p = (r / r.sum(1, keepdims=True)).mean(0)
        top = words.max(1)
        return p, float((top + np.log((np.exp(words - top[:, None]) * p).sum(1))).sum())

    price, k = 0.5 * np.log(max(len(words), 2)), len(names)
    free, _ = mixed([1] * k)
    single = words.sum(0)
    best, value, size = int(single.argmax()), single.max() - price, 1
    order = np.argsort(-free, kind="stable")
    for m in range(2, k + 1):
        share, found = mixed([int(j in order[:m]) for j in range(k)])
        if found - m * price > value:
            best, value, size = int(share.argmax()), found - m * price, m
    return names[best], float(free[best]), size


def lowered(text):
    raw = bytearray(text.encode())
    for i, c in enumerate(raw):
        if 65 <= c <= 90 or i and raw[i - 1] == 0xC3 and 0x80 <= c <= 0x9E and c != 0x97:
            raw[i] += 32
    return bytes(raw)


def test_predictions_equal_the_plain_loop(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, model = L.fit(df)
    logs = L.Likelihoods(*model).table
    rows = {r.doc_id: r.text for r in df.collect()}
    assert len(rows) >= 200
    for r in L.predict(df, names, model).collect():
        text = rows[r.doc_id] or ""
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif len(text) < 40_000:
            lang, score, size = plain(text, names, logs)
            assert (r.lang_pred, r.n_langs) == (lang, size) and abs(r.score - score) < 1e-3, r.doc_id


def test_long_texts_equal_their_words_at_once(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), DOCS)
    model = L.fit(df)
    rng = random.Random(6)
    asked = spark.createDataFrame([(i, say(rng, "xx", 300) + " " + say(rng, "yy", 80 * i), None, 0.0) for i in range(5)], DOCS)
    key = lambda: sorted((r.doc_id, r.lang_pred, round(r.score, 4), r.n_langs) for r in L.predict(asked, *model).collect())
    whole = key()
    monkeypatch.setattr(L, "PIECE", 700)
    assert key() == whole
