import random

from sigmill.llm import preferences as P

TURNS = "pair_id long, side string, turn long, role string, text string, place int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], TURNS)


def show(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def brute(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    out = [n, show(chosen[:n])]
    for side in (chosen, rejected):
        at, spans = 0, []
        for r, t in side[n:]:
            size = len(show([(r, t)]))
            if r == "assistant":
                spans.append((at + len(r) + 5, at + size - 1))
            at += size
        out += [show(side[n:]), spans]
    return out


def test_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    pairs, rows = {}, []
    for p in range(60):
        shared = [(rng.choice(["user", "assistant", "system"]), rng.choice(["hi", "yes é", "", "no\n"])) for _ in range(rng.randrange(0, 5))]
        sides = [shared + [(rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "🙂"])) for _ in range(rng.randrange(0, 4))] for _ in range(2)]
        if p % 10 == 9:
            sides[p % 2] = []
        if any(sides):
            pairs[p] = sides
        rows += [(p, s, i, r, t) for s, side in zip(("chosen", "rejected"), sides, strict=True) for i, (r, t) in enumerate(side)]
    rows += rng.sample(rows, 20)  # repeated rows
    rows += [(None, "chosen", 0, "user", "lost"), (1, "other", 0, "user", "lost")]
    rng.shuffle(rows)
    got = {r.pair_id: r for r in P.format_pairs(frame(spark, rows)).collect()}
    assert got.keys() == pairs.keys()
    for p, sides in pairs.items():
        r = got[p]
        have = [r.n_prompt_turns, r.prompt, r.chosen, [tuple(s) for s in r.chosen_mask], r.rejected, [tuple(s) for s in r.rejected_mask]]
        assert have == brute(*sides), p
        for body, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            assert all(body[s.start : s.end].endswith("<|end|>") for s in mask)


def test_nulls_ties_and_long_conversations(spark):
    rows = [(1, s, 0, None, None) for s in ("chosen", "rejected")] + [(1, "chosen", 5, "user", "b"), (1, "chosen", 5, "assistant", "a")]
    rows += [(2, s, i, "user", f"t{i}") for s in ("chosen", "rejected") for i in range(400)] + [(2, "rejected", 400, "assistant", "end")]
    got = {r.pair_id: r for r in P.format_pairs(frame(spark, rows)).collect()}
    assert got[1].prompt == "<||>\n<|end|>\n" and got[1].chosen == show([("assistant", "a"), ("user", "b")]) and got[1].rejected == ""
    assert got[2].n_prompt_turns == 400 and got[2].chosen == "" and [tuple(s) for s in got[2].rejected_mask] == [(14, 24)]
    assert P.format_pairs(frame(spark, [])).count() == 0


def test_adjacent_conversations(spark):
    rows = spark.createDataFrame([(c, 0, "user", f"c{c % 3}") for c in (0, 1, 2, 5)], "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in P.format_pairs(P.adjacent_pairs(rows)).collect()}
    assert got.keys() == {0, 1, 2} and got[2].chosen == "" and got[1].rejected == ""
