import hashlib
import random
import re

from sigmill.llm import infill as I

DOCS = "doc_id long, text string, n string, form string"
UNIT = re.compile(r"[\x20\t-\r]*[^\x20\t-\r]+|[\x20\t-\r]+")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    spm = h[3] % 100 < 80
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), sha(out), sha(text)


def rows():
    rng = random.Random(3)
    parts = ["word", " ", "  ", "\n", "\t\x0b\x0c\r", "é", "🙂", "\xa0", "\x1c", "\x85", "日本", "<", "P>", "<S", "M>", "x" * 50]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(400)]
    made += ["", None, " ", "\n\n", "a <P> b", "a <S> b", "<M>", "<P", "S><", "<<", "a<", "one", "word " * 300_000, " " * 200_000, "y" * 500_000]
    return [*enumerate(made), (None, "no id at all"), (7, made[7]), (10**15, "far away"), (-5, "below zero"), (3, "another text")]


def test_rows_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows()], DOCS)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, I.report(docs).collect())) == sorted(key(brute(i, t)) for i, t in rows())


def test_parts_and_exact_restoration(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows()], DOCS)
    texts = {(i, len(t or "")): t or "" for i, t in rows()}
    seen = set()
    for r in I.infill(docs, rate=100).collect():
        text = I.restore(r.output, r.form)
        assert text == texts[r.doc_id, len(text)]
        if r.form != "plain":
            assert r.prefix + r.middle + r.suffix == text and r.output == I.arrange(r.prefix, r.middle, r.suffix, r.form)
        seen.add(r.form)
    assert seen == {"plain", "psm", "spm"}
    assert {r.form for r in I.infill(docs, rate=0).collect()} == {"plain"}
    assert "psm" not in {r.form for r in I.infill(docs, rate=100, spm_rate=100).collect()}


def test_marks_that_only_touch(spark):
    for form in ("psm", "spm"):
        for prefix in ("<", "a<S", "P>", ""):
            for middle in ("<", "M>", "S>", ""):
                for suffix in ("<", "<P", "S><", ""):
                    assert I.restore(I.arrange(prefix, middle, suffix, form), form) == prefix + middle + suffix


def test_empty_table(spark):
    assert I.report(spark.createDataFrame([], DOCS)).count() == 0
    assert I.infill(spark.createDataFrame([], DOCS)).count() == 0
