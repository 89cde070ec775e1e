import hashlib
import random
import zlib

import numpy as np
import pytest

from sigmill.llm import prefixes as P

TURNS = "conv_id long, turn long, role string, text string, depth string, k0 int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], TURNS)


def brute(rows, period=20, heads=4):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        giver = c - int(np.fmod(c, period))
        rebuilt[c] = own.get(giver, [])[:h] + seq[h:]
    members = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        own_saved = (len(members[node]) - 1) * len(node[-1][1].encode().split()) if node else 0
        saved[node] = saved.get(node, 0) + own_saved
        leaves[node] = leaves.get(node, 0) if node in children else 1
        if node:
            up = node[:-1]
            children[up] = children.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[node]
            saved[up] = saved.get(up, 0) + saved[node]
    out = []
    for node, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(rebuilt[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ids), len(node), parent, len(ids), children.get(node, 0), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(rng, n, long=0):
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t if rng.random() > 0.05 else None, rng.choice(["user", "assistant", None]), rng.choice(["hi there", "a b c", "", None, "yes\tno\x0bé", "one two"])))
    rows += [(n + 3, t, "user", f"turn {t}") for t in range(long)] + [(n + 4, t, "user", f"turn {t}") for t in range(long + 2)]
    rows += [(-21, 0, "user", "below zero"), (-20, 0, "system", "giver"), (-20, 1, "user", "more"), (10**12, 5, "user", "far"), (None, 0, "user", "lost")]
    rows += rng.sample(rows, 10) + [(2, 0, "user", "a"), (2, 0, "assistant", "b")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("members", [2, 5, 4096])
def test_nodes_equal_brute_force(spark, members):
    rows = made(random.Random(members), 150, 60)
    got = P.trie(P.shared_heads(P.turns(frame(spark, rows))), members).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_a_hot_first_turn_and_copies(spark):
    rows = [(c, t, "user", "same words here" if t < 3 or c % 3 else f"own {c}") for c in range(300) for t in range(5)]
    assert sorted((tuple(r) for r in P.trie(P.shared_heads(P.turns(frame(spark, rows))), 8).collect()), key=str) == brute(rows)


def test_conversations_as_they_are(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a"), (3, 0, "ua", "")]
    got = {(r.conv_id, r.depth): r for r in P.trie(P.turns(frame(spark, rows))).collect()}
    assert got.keys() == {(1, 0), (1, 1), (1, 2), (3, 1)} and got[1, 1].saved_tokens == 1 and got[1, 0].n_leaves == 2
    assert got[1, 1].ends_sha256 == hashlib.sha256(b"2").hexdigest()


def test_ids_of_many_ranges_are_joined_in_order(spark):
    ids = [-9000, -1, 0, 5, 4095, 4096, 4097, 10**6, 10**15]
    got = P.trie(P.turns(frame(spark, [(c, 0, "u", "a") for c in ids]))).filter("depth = 1").collect()
    assert [r.ends_sha256 for r in got] == [hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]


def test_conversations_without_turns_and_empty_tables(spark):
    rows = [(c, 0, "u", "only turn") for c in range(1, 20)]
    got = P.trie(P.shared_heads(P.turns(frame(spark, rows)))).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows) and min(r.depth for r in got) == 0
    assert P.trie(P.shared_heads(P.turns(frame(spark, [])))).count() == 0


def test_louds():
    parents = np.array([0, 0, 1, 1, 2, 5, 5, 5])
    forest = P.Louds(parents)
    assert forest.parents().tolist() == parents.tolist() and "".join(map(str, forest.plain())) == "11011010001110000"
    first, counts = forest.children()
    assert counts.tolist() == [2, 2, 1, 0, 0, 3, 0, 0, 0] and [first[i] for i in (0, 1, 2, 5)] == [1, 3, 5, 6]
