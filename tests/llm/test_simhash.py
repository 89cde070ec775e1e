import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sigmill.llm import simhash as S
from sigmill.operators import graph

DOCS = "doc_id long, text string, fp long, component_id string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in texts], DOCS)


def plain(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64(b" ".join(w[i : i + 3]), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_hash_is_the_one_of_spark(spark):
    text = "Hällo wörld foo and a longer one over thirty-two bytes"
    joined = text.lower()
    assert spark.range(1).select(F.xxhash64(F.lit(joined)).alias("h")).first().h % 2**64 == xxhash.xxh64(joined.encode(), seed=42).intdigest()


def test_every_pair_within_the_radius_collides():
    masks = S.masks()
    assert len(masks) == 15
    rng = random.Random(2)
    for bits in [*itertools.combinations(range(0, 64, 5), 3), *(rng.sample(range(64), 3) for _ in range(3000))]:
        difference = sum(1 << b for b in bits)
        assert any(m & difference == 0 for m in masks)


def brute(texts):
    ids = [i for i, t in texts]
    fps = np.array([plain(t) for _, t in texts], np.uint64)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if np.bitwise_count(fps[a] ^ fps[b]) <= 3:
            parent[find(b)] = find(a)
    groups = {}
    for k in range(len(texts)):
        groups.setdefault(find(k), []).append(ids[k])
    return sorted((str(ids[k]), f"{int(fps[k]):016x}", str(min((i for i in groups[find(k)] if i is not None), default=None))) for k in range(len(texts)))


def corpus():
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(n))
    base = [say(rng.randrange(1, 60)) for _ in range(40)]
    texts = [(i, t) for i, t in enumerate(base)]
    for k in range(120):  # near copies with one word changed
        w = base[k % 5].split() * 8
        w[rng.randrange(len(w))] = "zz"
        texts.append((100 + k, " ".join(w)))
    return texts + [(300, None), (301, ""), (302, " \t\n"), (303, base[1].upper()), (303, base[1]), (None, base[2]), (304, "one two"), (None, "alone here now")]


def test_components_equal_brute_force(spark):
    texts = corpus()
    got = S.near_duplicates(frame(spark, texts)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == brute(texts)


def test_blocks_of_large_buckets_give_the_same_links(spark):
    nodes = spark.createDataFrame([(np.uint64(plain(t)).astype(np.int64).item(),) for _, t in corpus()], "fp long").distinct()
    parts = [{tuple(sorted(m)) for m in members(S.components(S.links(nodes, block=b)))} for b in (5, 2048)]
    assert parts[0] == parts[1]


def members(components):
    groups = {}
    for r in components.collect():
        groups.setdefault(r.root, []).append(r.node)
    return groups.values()


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    out = S.components(edges).collect()
    assert len(out) == 201 and {r.root for r in out} == {0}
    assert S.components(edges.limit(0)).count() == 0


def test_one_of_each_component_stays(spark):
    docs = frame(spark, corpus())
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    want = {c for _, _, c in brute(corpus())} - {"None"}
    assert sorted(map(str, ids)) == sorted(want)
    assert S.near_duplicates(frame(spark, [])).count() == 0


def test_components_in_one_or_in_many_partitions(spark, monkeypatch):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    root = {n: n for e in edges for n in e if e[0] != e[1]}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    df = spark.createDataFrame(edges, "x long, y long")
    for few in (0, graph.FEW_EDGES):
        monkeypatch.setattr(graph, "FEW_EDGES", few)
        assert {(r.node, r.root) for r in S.components(df).collect()} == {(n, find(n)) for n in root}
