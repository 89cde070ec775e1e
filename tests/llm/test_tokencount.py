import json
import random
import re

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from sigmill.llm import tokencount as T  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, n_tokens string"


def texts():
    rng = random.Random(1)
    parts = ["the", " world", "  ", "\n\n", "é", "日本", "123", "'ll", "<|endoftext|>", "!!!", " Ünï", "\t", "x" * 30, " ", "🙂", "don't", " ", " \n"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    return [*made, "", "a" * 50_000, " " * 3000, "<|endoftext|>", "<|endoftext|><|endoftext|> a", "<|endof", "lorem ipsum " * 20_000]


def test_counts_are_those_of_the_library(spark):
    rows = [*enumerate(texts()), (9000, None), (9001, "twice"), (9001, "twice"), (None, "no id")]
    library = Tokenizer.from_file(PATH)
    want = sorted((str(i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows)
    got = T.count_tokens(spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS), PATH).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_proven_strings_are_single_tokens():
    with open(PATH, encoding="utf-8") as file:
        content = file.read()
    proven = T.prove(content)
    library = Tokenizer.from_str(content)
    assert len(proven) > 45_000 and "<|endoftext|>" not in proven
    assert all(len(library.encode(s, add_special_tokens=False).ids) == 1 for s in random.Random(2).sample(sorted(proven), 500))


def agree(texts):
    with open(PATH, encoding="utf-8") as file:
        content = file.read()
    counter = T.Counter(content, T.prove(content), T.differing(content))
    want = [len(e.ids) for e in Tokenizer.from_str(content).encode_batch(texts, add_special_tokens=False)]
    assert [t for t, n in zip(texts, want, strict=True) if counter.count(t) != n] == []


def test_code_points_of_both_unicode_tables():
    with open(PATH, encoding="utf-8") as file:
        unsure = T.differing(file.read())
    ends = [int(x, 16) for x in re.findall(r"\\U([0-9a-f]{8})", unsure)]
    assert len(ends) > 20
    points = {e + d for e in ends for d in (-2, -1, 0, 1, 2)} | set(range(0, 0x110000, 97)) | set(range(0x3000))
    points = [chr(x) for x in sorted(points) if not 0xD800 <= x < 0xE000]
    agree([text for c in points for text in (f"a{c}1.", f"{c}'s", f"'s{c}", f" {c} {c}\n{c}")])


def test_random_strings():
    rng = random.Random(5)
    parts = ["a", " ", "'s", "\n", "'ll", "₞", "⁾", "¬", "1", "  ", "é", "\u3000", "\xa0", "<|endoftext|>"]
    point = lambda: chr(rng.choice((rng.randrange(0xD800), rng.randrange(0xE000, 0x110000))))
    agree(["₞'s's⁾\n¬\n", *("".join(rng.choice(parts) if rng.random() < 0.6 else point() for _ in range(rng.randrange(1, 20))) for _ in range(30_000))])


@pytest.mark.parametrize("change", ["use_regex", "dropout", "ignore_merges", "lstrip", "rstrip", "single_word", "normalized"])
def test_rules_that_the_shortcut_ignores_are_refused(change):
    with open(PATH, encoding="utf-8") as file:
        config = json.load(file)
    if change == "use_regex":
        config["pre_tokenizer"]["use_regex"] = False
    elif change in ("dropout", "ignore_merges"):
        config["model"][change] = 0.1 if change == "dropout" else True
    else:
        config["added_tokens"][0][change] = True
    with pytest.raises(ValueError, match="not supported"):
        T.supported(config)


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(T, "_MEMO", 10)
    with open(PATH, encoding="utf-8") as file:
        content = file.read()
    counter = T.Counter(content, frozenset({"the"}), "")
    assert counter.count(" ".join(f"qzx{i}" for i in range(200))) == len(Tokenizer.from_str(content).encode(" ".join(f"qzx{i}" for i in range(200))).ids)
    assert len(counter) <= 12


def test_empty_table_and_unsupported_files(spark):
    assert T.count_tokens(spark.createDataFrame([], DOCS), PATH).count() == 0
    with pytest.raises(ValueError, match="byte-level"):
        T.count_tokens(spark.createDataFrame([], DOCS), public_tokenizers.path("word_bpe_49k.json"))
