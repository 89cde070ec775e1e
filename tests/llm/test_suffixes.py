import hashlib
import random

import numpy as np
import pytest

from sigmill.llm import induced as I
from sigmill.llm import suffixes as S

DOCS = "doc_id long, text string, key long, shard string, at int"


def brute(rows, width=100):
    """Every string of width bytes in order of appearance; rows equal in id and text are one document."""
    docs = sorted({(i is None, i or 0, t) for i, t in rows}, key=lambda x: x[:2])
    seen, out = set(), {}
    for none, i, text in docs:
        data = (text or "").encode()
        covered = np.zeros(len(data), bool)
        for p in range(len(data) - width + 1):
            window = data[p : p + width]
            if window in seen:
                covered[p : p + width] = True
            seen.add(window)
        kept = bytes(np.frombuffer(data, np.uint8)[~covered])
        spans = int((np.diff(covered.astype(np.int8), prepend=0) == 1).sum())
        out[none, i, text] = len(data), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()
    return sorted((str(i), *out[i is None, i or 0, t]) for i, t in rows)


def got(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], DOCS).repartition(3)
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.report(docs, **options).collect())


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    passages = [" ".join(word() for _ in range(rng.randrange(10, 60))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 6))]
        text = " ".join(parts)
        if rng.random() < 0.1:
            at = rng.randrange(len(text))
            text = text[:at] + "X" + text[at + 1 :]
        rows.append((i, text))
    rows += [(1000 + k, rows[k * 3][1]) for k in range(20)] + [(2000 + k, rows[k][1][: 200 + k]) for k in range(20)]
    rows += [(3000, "a" * 3000), (3001, "ab" * 700), (3002, "a" * 99), (3003, "a" * 100), (3004, ""), (3005, None), (3006, None), (None, rows[5][1] + " end"), (5, rows[5][1]), (-3, rows[9][1])]
    rows += [(3007, "日本語テキスト" * 40), (3008, passages[0] * 3)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"shard": 3000, "memory": 4000}), (3, {"hot": 3, "shard": 5000})])
def test_results_equal_brute_force(spark, seed, options):
    rows = made(seed)
    assert got(spark, rows, **options) == brute(rows)


@pytest.mark.parametrize(("width", "span"), [(20, 10), (20, 1), (12, 11)])
def test_other_widths(spark, width, span):
    rows = made(width)[:80]
    assert got(spark, rows, width=width, span=span) == brute(rows, width)


def test_texts_over_a_block(spark, monkeypatch):
    monkeypatch.setattr(S, "_BLOCK", 512)
    S._powers.cache_clear()
    rows = made(8)[:60]
    assert got(spark, rows) == brute(rows)
    S._powers.cache_clear()


def test_the_test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((str(r.doc_id), *r[1:]) for r in S.report(docs).collect()) == brute(rows)


def test_bytes_that_stay(spark):
    text = " ".join(str(x * x) for x in range(60))
    docs = spark.createDataFrame([(1, text), (2, f"before {text} after"), (3, "short")], "doc_id long, text string")
    kept = {r.doc_id: (bytes(r.kept), r.n_spans) for r in S.deduplicate(docs).collect()}
    assert kept == {1: (text.encode(), 0), 2: (b"before  after", 1), 3: (b"short", 0)}


def test_empty_table(spark):
    assert S.report(spark.createDataFrame([], DOCS)).count() == 0


def test_contexts_divide_the_windows():
    rng = random.Random(4)
    for n in (0, 99, 100, 101, 5000, 140_000):
        text = bytes(rng.choice(b"abcd ") for _ in range(n))
        key, start, count = S.contexts(text)
        assert int(count.sum()) == max(0, n - 99) and (np.diff(start) == count[:-1]).all() and (count.max(initial=0) <= S._BLOCK)
    # The same window has the same anchor wherever it stands.
    shared = bytes(rng.choice(b"abcd ") for _ in range(400))
    keys = [set(S.contexts(bytes(rng.choice(b"xyz") for _ in range(pad)) + shared)[0].tolist()) for pad in (0, 13, 200)]
    assert len(keys[0] & keys[1] & keys[2]) >= 5


def test_ranges_are_merged_by_owner():
    owner, start, end = S.merged(np.array([1, 0, 0, 1, 0]), np.array([5, 0, 10, 2, 3]), np.array([9, 4, 12, 6, 5]))
    assert list(zip(owner.tolist(), start.tolist(), end.tolist(), strict=True)) == [(0, 0, 5), (0, 10, 12), (1, 2, 9)]


@pytest.mark.parametrize("memory", [1 << 26, 300])
def test_induced_order_and_values_equal_plain_sorting(memory):
    rng = random.Random(memory)
    for trial in range(120):
        letters = rng.choice([b"ab", b"abc", b"abcdefgh", bytes(range(256))])
        strings = [bytes(rng.choice(letters) for _ in range(rng.randrange(0, rng.choice([5, 40, 120])))) for _ in range(rng.randrange(1, 8))]
        strings += [rng.choice(strings) for _ in range(3)] + [b"a" * rng.randrange(0, 60)]
        cap = rng.choice([5, 20, 100])
        codes, n, sigma = I.encoded(strings, cap, I.Store(memory))
        places, values = (np.concatenate(c).tolist() for c in zip(*I.ordered(codes, n, sigma, memory, cap, rng.choice([None, 3, 7])), strict=True))
        plain = codes[:n].tolist()
        assert places == sorted(range(n), key=lambda i: plain[i:]), trial
        for a, b, value in zip(places, places[1:], values[1:], strict=False):
            k = 0
            while k < cap and max(a, b) + k < n and plain[a + k] == plain[b + k]:
                k += 1
            assert k == value, trial


def test_hashes_are_those_of_the_substrings_wherever_they_stand():
    rng = random.Random(6)
    shared = bytes(rng.choice(b"abcd ") for _ in range(100))
    found = [S.contexts(bytes(rng.choice(b"abcd ") for _ in range(pad)) + shared, 100, 1)[0][-1] for pad in (0, 1, 700, 60_000)]
    assert len(set(found)) == 1 and found[0] != 0
