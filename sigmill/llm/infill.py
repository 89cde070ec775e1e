"""Operator 12: fill-in-the-middle transformation.

The tokenizers library cuts a text by its Split pre-tokenizer, which isolates the
matches of a pattern and tells their code-point offsets; nothing is trained. The
pieces of `UNITS` cover a text without gaps, so the number of offsets is n, and
the offsets at two ranks cut the text into prefix, middle and suffix.

The ranks, the choice between plain and rearranged, and the order of the parts
come from four numbers of a SHA-256 of seed and doc_id, so reruns and any
partitioning agree:

    psm  <P>prefix<S>suffix<M>middle
    spm  <S>suffix<P>prefix<M>middle

A text that holds one of the three marks stays plain, so `restore` gets the
exact text back from an output and its form.

Defined cases: null and empty texts are plain, with n 0 and an empty output; a
null doc_id counts as an empty one; repeated rows are cut alike; a middle may be
empty; texts of any length are cut whole; an empty table gives no rows. Other
columns of the table are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

from .common import utf8

#: Blanks and the word after them, or the blanks at the end.
UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of 100 texts, those that are rearranged, and of 100 of these, those that begin with the suffix.
RATE = 50
SPM_RATE = 80

SCHEMA = "n long, form string, prefix string, middle string, suffix string, output string"


def splitter(pattern: str = UNITS):
    """text -> [(piece, (start, end))] of code points."""
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(pattern), behavior="isolated").pre_tokenize_str


def draws(doc_id, seed: int = SEED) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def arrange(prefix: str, middle: str, suffix: str, form: str) -> str:
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    # No part holds a mark, and no mark overlaps another, so each mark's first place is its own.
    a, _, rest = output.removeprefix(first).partition(second)
    b, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (a, b) if form == "psm" else (b, a)
    return prefix + middle + suffix


def transform(doc_id, text: str, split, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED):
    """(n, form, prefix, middle, suffix, output) of one text; the parts are None if plain."""
    offsets = [at for _, at in split(text)] if text else []
    n = len(offsets)
    one, two, three, four = draws(doc_id, seed)
    if not n or three % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, None, text
    low, high = sorted((one % (n + 1), two % (n + 1)))
    cut = [offsets[k - 1][1] if k else 0 for k in (low, high)]
    parts = text[: cut[0]], text[cut[0] : cut[1]], text[cut[1] :]
    form = "spm" if four % 100 < spm_rate else "psm"
    return n, form, *parts, arrange(*parts, form)


def _mapped(docs: DataFrame, columns: str, make, rate: int, spm_rate: int, seed: int, pattern: str) -> DataFrame:
    """doc_id and `columns` by make(text, *transform(...)) for each row."""
    docs = docs.select("doc_id", "text")
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        import pyarrow as pa

        split = splitter(pattern)
        kinds = [pa.int64() if c.endswith("long") else pa.large_string() for c in columns.split(", ")]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = (t.decode() for t in utf8(batch, "text"))
            rows = [make(t, *transform(i, t, split, rate, spm_rate, seed)) for i, t in zip(ids, texts, strict=True)]
            made = [pa.array(list(column), kind) for column, kind in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)]
            made = [a.cast(pa.string()) if a.type == pa.large_string() else a for a in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", *names])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {columns}")


def infill(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED, pattern: str = UNITS) -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output) for each row of docs."""
    return _mapped(docs, SCHEMA, lambda text, *made: made, rate, spm_rate, seed, pattern)


def report(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED, pattern: str = UNITS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): `infill` with its texts as lengths and digests."""

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def make(text, n, form, prefix, middle, suffix, output):
        sizes = (None, None) if prefix is None else (len(prefix), len(middle))
        return n, form, *sizes, digest(output), digest(restore(output, form))

    columns = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return _mapped(docs, columns, make, rate, spm_rate, seed, pattern)
