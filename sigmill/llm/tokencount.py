"""Operator 9: token counts by the whole-token shortcut.

Once, on the driver, every string of the vocabulary is encoded alone; those that
come back as the single token they name, from a single pre-token, are proven
whole. Documents are cut into pre-tokens; a pre-token among the proven strings
counts as one, and only the rest is merged by the tokenizer itself, each
distinct one once while a bounded memo holds it.

The cutter is a regular expression whose Unicode tables need not be those of the
tokenizer's library. The driver therefore also compares the class (letter,
number, blank, other) that both give to every code point, and texts that hold a
code point on which they differ are encoded whole by the library.

Special strings inside a text are single tokens and cut the text, as the
library does by default. The proven set and the tokenizer's file (both of the
vocabulary's size) are broadcast.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows
are counted alike; pre-tokens of any length are merged whole; truncation and
padding that a file asks for are left out.
"""

from __future__ import annotations

import json
import re
from functools import cache

from pyspark.sql import DataFrame

from .common import utf8

LIMIT = 512
#: Pre-tokens of byte-level BPE files whose pre-tokenizer has no pattern of its own.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MEMO = 400_000
_LONGEST_KEPT = 64


def supported(config: dict) -> None:
    """Raises for a tokenizer whose texts don't simply fall into pre-tokens that are merged apart."""
    cut, model = config.get("pre_tokenizer") or {}, config["model"]
    if config.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or model["type"] != "BPE":
        raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
    if not cut.get("use_regex", True) or model.get("dropout") or model.get("ignore_merges"):
        raise ValueError("byte-level BPE without its pattern, with dropout or with ignored merges is not supported")
    for token in config.get("added_tokens", []):
        if any(token.get(flag) for flag in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError(f"added token {token['content']!r} has rules of its own, which are not supported")


def library(content: str):
    """The tokenizer of a file without truncation and padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@cache
def differing(content: str) -> str:
    """A character class, empty if none, of the code points that the cutter and the library put into different classes.

    Each class's code points, one after the other, are cut by the library; the first of a piece tells the piece's class.
    """
    import regex

    cut = library(content).pre_tokenizer.pre_tokenize_str
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    classes = {"a": r"\p{L}", "1": r"\p{N}", ".": r"[^\s\p{L}\p{N}]", " ": r"\s"}

    def of_library(c: str) -> str:
        return next((k for k in "a1." if len(cut(k + c)) == 1), " ")

    found: list[int] = []
    for name, pattern in classes.items():
        mine = "".join(regex.findall(pattern + "+", every))
        for _, (i, j) in cut(mine):
            if of_library(mine[i]) != name:
                found += map(ord, mine[i:j])
    ranges: list[list[int]] = []
    for c in sorted(found):
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


class Counter(dict):
    """Tokens of a pre-token; starts with the proven strings."""

    def __init__(self, content: str, proven: frozenset[str], unsure: str):
        import regex

        super().__init__(dict.fromkeys(proven, 1))
        self.tokenizer = library(content)
        self.cut = regex.compile(BYTE_LEVEL).findall
        specials = sorted((t["content"] for t in json.loads(content).get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.proven = proven
        self.unsure = re.compile(f"[{unsure}]").search if unsure else lambda text: None

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, piece: str) -> int:
        count = self.whole(piece)
        if len(piece) <= _LONGEST_KEPT:
            if len(self) > len(self.proven) + _MEMO:
                self.clear()
                self.update(dict.fromkeys(self.proven, 1))
            self[piece] = count
        return count

    def plain(self, text: str) -> int:
        return sum(map(self.__getitem__, self.cut(text)))

    def count(self, text: str) -> int:
        if not text.isascii() and self.unsure(text):
            return self.whole(text)
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


def prove(content: str) -> frozenset[str]:
    """Vocabulary strings that alone are one pre-token and encode as their own id."""
    import regex

    supported(json.loads(content))
    tokenizer = library(content)
    specials = {t["content"] for t in json.loads(content).get("added_tokens", [])}
    cut = regex.compile(BYTE_LEVEL)
    entries = [(tokenizer.decode([i], skip_special_tokens=False), i) for i in range(tokenizer.get_vocab_size())]
    entries = [(s, i) for s, i in entries if s and "�" not in s and s not in specials and cut.fullmatch(s)]
    entries = [(s, i) for s, i in entries if cut.findall(s) == [s]]
    encoded = tokenizer.encode_batch([s for s, _ in entries], add_special_tokens=False)
    return frozenset(s for (s, i), e in zip(entries, encoded, strict=True) if e.ids == [i])


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row; path: a byte-level BPE tokenizer.json."""
    with open(path, encoding="utf-8") as file:
        content = file.read()
    shared = docs.sparkSession.sparkContext.broadcast((content, prove(content), differing(content)))
    docs = docs.select("doc_id", "text")

    def run(batches):
        import os

        import pyarrow as pa

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        counter = Counter(*shared.value)
        for batch in batches:
            texts = utf8(batch, "text")
            counts = [counter.count(t.decode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([c > limit for c in counts], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
