import hashlib
import random
import re

import pytest

from sigmill.llm import decontaminate as D

BENCH = "item_id long, text string"
DOCS = "doc_id long, text string, n_chars long, item_id string, n_words int"


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, None if t is None else len(t), "x", 0) for i, t in texts], DOCS)


def plain_words(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, items, n=10):
    w = plain_words(text)
    hit, found = set(), set()
    for item, content in items:
        v = plain_words(content)
        size = min(n, len(v))
        for i in range(len(v) - size + 1 if v else 0):
            for j in range(len(w) - size + 1):
                if w[j : j + size] == v[i : i + size]:
                    hit.update(range(j, j + size))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(1)
    letters = ["uno", "dos", "Tres", "é", "x1", "Ünf", "seis"]
    say = lambda n: " ".join(rng.choice(letters) for _ in range(n))
    items = [(i, say(rng.randrange(8, 25))) for i in range(12)] + [(12, "short one"), (13, ""), (14, None), (None, say(12)), (10, "short one")]
    docs = [(i, say(40) + "; " + (items[i % 12][1] if i % 2 else "") + "\n" + say(30)) for i in range(20)]
    docs += [(20, None), (21, ""), (22, "a SHORT, one!"), (23, "a SHORT, one!"), (23, "a SHORT, one!"), (24, items[3][1] * 500), (None, "short one"), (25, "!!! ...")]
    return items, docs


@pytest.mark.parametrize("limit", [D.MAX_BROADCAST_BYTES, 0])
def test_report_equals_brute_force(spark, case, limit):
    items, docs = case
    got = D.report(rows_of(spark, docs), spark.createDataFrame(items, BENCH), limit=limit).collect()
    assert len(got) == len(docs)
    want = sorted((str(i), *brute(t, items)) for i, t in docs)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.items) for r in got) == want


def test_removal(spark, case):
    items, docs = case
    bench, frame = spark.createDataFrame(items, BENCH), rows_of(spark, docs)
    clean = D.remove(frame, bench)
    assert clean.columns == frame.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, t in docs if brute(t, items)[1] == 0)
    cut = D.remove(frame, bench, "span").collect()
    assert len(cut) == len(docs)
    for r in cut:
        assert r.text is None or r.n_chars == len(r.text)
    assert next(r.text for r in cut if r.doc_id == 22) == "a !"


@pytest.mark.parametrize("limit", [D.MAX_BROADCAST_BYTES, 0])
@pytest.mark.parametrize("mode", ["document", "span"])
def test_internal_names_as_extra_columns(spark, case, monkeypatch, limit, mode):
    items, docs = case
    monkeypatch.setattr(D, "fits_broadcast", lambda benchmark: limit > 0)
    names = ["row", "key", "items", "hit_words", "found", "salt", "gram", "size", "at", "spans"]
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    frame = spark.createDataFrame([(i, t, None if t is None else len(t), *range(len(names))) for i, t in docs], schema)
    out = D.remove(frame, spark.createDataFrame(items, BENCH), mode)
    assert out.columns == frame.columns
    rows = out.collect()
    assert {tuple(r)[3:] for r in rows} == {tuple(range(len(names)))}
    hit = {i for i, t in docs if brute(t, items)[1]}
    assert len(rows) == (len(docs) if mode == "span" else sum(i not in hit for i, _ in docs))
    assert all(r.text is None or (brute(r.text, items)[1] == 0 or mode == "span") and r.n_chars == len(r.text) for r in rows)


def test_windows_that_clash_get_another_multiplier(monkeypatch):
    monkeypatch.setattr(D, "_MULTIPLIERS", (0, *D._MULTIPLIERS))  # the first hashes a window by its last word alone
    items = [(1, "a b c"), (2, "d e c"), (3, "x a b c")]
    known = D.WindowSet(items, 2)
    hit, found = known.scan(b"a b c d".split())
    assert hit.tolist() == [True, True, True, False] and found == {0, 2}


def test_empty_tables(spark, case):
    items, docs = case
    none = spark.createDataFrame([], BENCH)
    assert {r.n_hit for r in D.report(rows_of(spark, docs), none).collect()} == {0}
    assert D.report(rows_of(spark, []), spark.createDataFrame(items, BENCH)).count() == 0


def test_digest():
    assert D.digest([]) == hashlib.sha256(b"").hexdigest() and D.digest(["1", "10"]) == hashlib.sha256(b"1,10").hexdigest()
