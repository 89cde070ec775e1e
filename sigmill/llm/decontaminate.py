"""Operator 1: benchmark decontamination.

The benchmark's word windows (n-grams) form a hash set that is broadcast while
its measured size stays under a bound; every document is scanned once, word
windows whose rolling hash is in the set are verified word by word, and hit
words, spans or whole documents can be reported or removed. A benchmark beyond
the bound goes through a shuffled join of the windows' words instead.

Defined cases: a null text has no words and is never hit; an item without words
has no window; an item shorter than a window is one window of its own length;
items that share a window are all reported; repeated documents are judged row
by row; items with a null id hit words but are not listed. Extra columns pass
through untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, utf8

WINDOW = 10
#: UTF-8 bytes of benchmark text up to which its windows are broadcast.
MAX_BROADCAST_BYTES = 8 << 20
#: Parts into which a window of the join is split, by document.
SALTS = 16

REPORT = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
#: Odd multipliers of the rolling hash; the next is taken where two different windows of the items clash.
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(WORD_BYTES).split()


def windows(tokens: list, n: int = WINDOW) -> list[tuple]:
    if not tokens:
        return []
    return [tuple(tokens[i : i + n]) for i in range(max(1, len(tokens) - n + 1))]


class WindowSet:
    """Hash set of the items' windows over the items' own vocabulary, built once on the driver.

    For each length of windows: their sorted hashes, where in the items' words (flat) each one stands, and its items.
    """

    def __init__(self, items: list[tuple], n: int = WINDOW):
        import numpy as np

        self.vocabulary: dict[bytes, int] = {}
        self.item_ids: list[str | None] = [None if item_id is None else str(item_id) for item_id, _ in items]
        ids = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words((text or "").encode())] for _, text in items]
        self.flat = np.array([x for item in ids for x in item], np.int64)
        sizes = np.array([len(item) for item in ids], np.int64)
        begins = np.cumsum(sizes) - sizes
        self.tables = {}
        for size in sorted({min(n, s) for s in sizes.tolist()} - {0}):
            chosen = np.flatnonzero(sizes >= n) if size == n else np.flatnonzero(sizes == size)
            count = sizes[chosen] - size + 1
            owner = np.repeat(chosen, count)
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begins[chosen], count)
            self.tables[size] = self._table(at, owner, size)

    @classmethod
    def of(cls, parts: dict) -> WindowSet:
        """The set that has these parts; nothing is built anew."""
        known = cls.__new__(cls)
        known.__dict__.update(parts)
        return known

    def _table(self, at, owner, size: int):
        import numpy as np

        for multiplier in _MULTIPLIERS:
            hashed = self.rolling(self.flat, at, size, multiplier)
            order = np.lexsort((owner, hashed))
            ordered = hashed[order]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            runs = np.diff(np.append(first, len(order)))
            lead = np.repeat(at[order[first]], runs)
            if all((self.flat[at[order] + j] == self.flat[lead + j]).all() for j in range(size)):
                return multiplier, ordered[first], at[order[first]], np.append(first, len(order)), owner[order]
        raise ValueError("windows clash under every multiplier")

    @staticmethod
    def rolling(ids, at, size: int, multiplier: int):
        """A 64-bit hash of the `size` ids from each of the places `at`."""
        import numpy as np

        out = np.zeros(len(at), np.uint64)
        for j in range(size):
            out = out * np.uint64(multiplier) + (ids[at + j] + 1).astype(np.uint64)
        return out ^ (out >> np.uint64(31))

    def scan(self, tokens: list[bytes]):
        """(hit flags by word, numbers of the items with an occurring window)."""
        import numpy as np

        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in tokens), np.int64, len(tokens))
        hit = np.zeros(len(tokens) + 1, np.int64)
        found: set[int] = set()
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        for size, (multiplier, hashes, places, cuts, owners) in self.tables.items():
            if len(tokens) < size:
                continue
            starts = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(starts):
                continue
            hashed = self.rolling(ids, starts, size, multiplier)
            at = np.minimum(np.searchsorted(hashes, hashed), len(hashes) - 1)
            same = hashes[at] == hashed
            starts, at = starts[same], at[same]
            for j in range(size):
                same = ids[starts + j] == self.flat[places[at] + j]
                starts, at = starts[same], at[same]
            hit += np.bincount(starts, minlength=len(hit)) - np.bincount(starts + size, minlength=len(hit))
            for k in np.unique(at).tolist():
                found.update(owners[cuts[k] : cuts[k + 1]].tolist())
        return np.cumsum(hit[:-1]) > 0, found


def _spans(text: bytes, hit) -> list[dict]:
    """Code-point spans of the runs of hit words."""
    spans, last, seen, chars = [], -2, 0, 0
    for i, match in enumerate(_WORD.finditer(text)):
        if not hit[i]:
            continue
        chars += len(text[seen : match.start()].decode())
        start = chars
        chars += len(match.group().decode())
        seen = match.end()
        if i == last + 1:
            spans[-1]["end"] = chars
        else:
            spans.append({"start": start, "end": chars})
        last = i
    return spans


def fits_broadcast(benchmark: DataFrame, limit: int = MAX_BROADCAST_BYTES) -> bool:
    row = benchmark.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()
    return row.n <= limit


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) for each row of docs; items are sorted as strings."""
    docs = docs.select("doc_id", "text")
    if not fits_broadcast(benchmark, limit):
        return _report_by_join(docs, benchmark, n)
    shared = _broadcast(benchmark, n)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        import pyarrow as pa

        known = WindowSet.of(shared.value)
        for batch in batches:
            out = []
            for text in utf8(batch, "text"):
                tokens = words(text)
                hit, found = known.scan(tokens)
                items = sorted({known.item_ids[k] for k in found} - {None})
                out.append((len(tokens), int(hit.sum()), items, _spans(text, hit) if hit.any() else []))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.list_(pa.string())),
                    pa.array(columns[3], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                ["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return docs.mapInArrow(scan, f"doc_id {kind}, {REPORT}")


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "document", n: int = WINDOW) -> DataFrame:
    """docs without hit documents (mode "document") or with the hit spans cut out of `text` (mode "span").

    All columns stay; in span mode n_chars, where present, is recounted.
    """
    if mode not in ("document", "span"):
        raise ValueError(f"unknown mode {mode}")
    if not fits_broadcast(benchmark):
        return _remove_by_join(docs, benchmark, mode, n)
    shared = _broadcast(benchmark, n)

    def scan(batches):
        import pyarrow as pa

        known = WindowSet.of(shared.value)
        for batch in batches:
            texts = utf8(batch, "text")
            hits = [known.scan(words(text))[0] for text in texts]
            if mode == "document":
                yield batch.filter(pa.array([not h.any() for h in hits], pa.bool_()))
                continue
            at = batch.schema.get_field_index("text")
            kept = batch.column(at).to_pylist()
            for i, h in enumerate(hits):
                if h.any():
                    kept[i] = cut(kept[i], [(s["start"], s["end"]) for s in _spans(texts[i], h)])
            batch = batch.set_column(at, batch.schema.field(at), pa.array(kept, batch.schema.field(at).type))
            if "n_chars" in batch.schema.names:
                at = batch.schema.get_field_index("n_chars")
                counts = pa.array([None if t is None else len(t) for t in kept], batch.schema.field(at).type)
                batch = batch.set_column(at, batch.schema.field(at), counts)
            yield batch

    return docs.mapInArrow(scan, docs.schema)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return "".join([*out, text[at:]])


def digest(items: list[str] | None) -> str:
    return hashlib.sha256(",".join(items or []).encode()).hexdigest()


def _broadcast(benchmark: DataFrame, n: int):
    items = [(r.item_id, r.text) for r in benchmark.select("item_id", "text").toLocalIterator()]
    return benchmark.sparkSession.sparkContext.broadcast(vars(WindowSet(items, n)))


def _grams(df: DataFrame, n: int, lengths: list[int], carried: str) -> DataFrame:
    """One row for each window: the carried columns, its position, length and words."""

    def explode(batches):
        import pyarrow as pa

        for batch in batches:
            rows, at, size, gram = [], [], [], []
            for i, text in enumerate(utf8(batch, "text")):
                tokens = words(text)
                for k in lengths or [min(n, len(tokens))]:
                    for j in range(len(tokens) - k + 1 if k else 0):
                        rows.append(i), at.append(j), size.append(k), gram.append(b" ".join(tokens[j : j + k]))
                    if len(gram) > 50_000:
                        yield from _emit(pa, batch, rows, at, size, gram)
                        rows, at, size, gram = [], [], [], []
            yield from _emit(pa, batch, rows, at, size, gram)

    return df.mapInArrow(explode, f"{carried}, at long, size long, gram binary")


def _emit(pa, batch, rows, at, size, gram):
    picked = batch.select([c for c in batch.schema.names if c != "text"]).take(pa.array(rows, pa.int64()))
    yield pa.RecordBatch.from_arrays(
        [*picked.columns, pa.array(at, pa.int64()), pa.array(size, pa.int64()), pa.array(gram, pa.binary())],
        [*picked.schema.names, "at", "size", "gram"],
    )


def _hits_by_join(keyed: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """(key, hit_words, items) of the texts with a hit; keyed has key and text.

    Windows of the documents meet the items' distinct windows, each with its list of items; a window that many documents hold
    is spread by a salt of the document.
    """
    item = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    owned = _grams(item, n, [], "item_id string").select("item_id", "size", "gram").distinct()
    lengths = [r.size for r in owned.select("size").distinct().collect()]  # n values at most
    windowed = _grams(keyed.select("key", "text"), n, lengths or [n], "key string")
    salted = owned.groupBy("size", "gram").agg(F.collect_list("item_id").alias("items"))
    salted = salted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = windowed.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["size", "gram", "salt"])
    return (
        met.groupBy("key")
        .agg(F.collect_set(F.struct("at", "size")).alias("found"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
        .withColumn(
            "hit_words",
            F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda x: F.sequence(x["at"], x["at"] + x["size"] - 1))))),
        )
        .select("key", "hit_words", F.array_sort("items").alias("items"))
    )


def _marked(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """(row, text, hit_words, items): each row of docs in a struct; equal texts share a 128-bit key and their hits."""
    held = docs.select(F.struct("*").alias("row"), "text", F.md5(F.col("text").cast("binary")).alias("key"))
    hits = _hits_by_join(held.select("key", "text").dropDuplicates(["key"]), benchmark, n)
    return held.join(hits, "key", "left").select("row", "text", "hit_words", "items")


def _report_by_join(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    spans = _by_batch(_spans_of, "array<struct<start:long,end:long>>")("text", "hit_words")
    return _marked(docs, benchmark, n).select(
        "row.doc_id",
        _n_words("text").alias("n_words"),
        F.coalesce(F.size("hit_words"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        spans.alias("spans"),
    )


def _remove_by_join(docs: DataFrame, benchmark: DataFrame, mode: str, n: int) -> DataFrame:
    marked = _marked(docs, benchmark, n)
    if mode == "document":
        return marked.filter(F.col("hit_words").isNull()).select("row.*")
    out = marked.select("row", _by_batch(_without, "string")("text", "hit_words").alias("text"))
    changed = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns])


def _by_batch(one, kind: str):
    """A function of text and hit words over Arrow batches."""

    def run(texts: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([one(t, h) for t, h in zip(texts, hits, strict=True)])

    return F.pandas_udf(run, kind)


def _n_words(text: str):
    return F.coalesce(F.regexp_count(text, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")), F.lit(0)).cast("long")


def _flags(text: bytes, hit_words) -> list[bool]:
    flags = [False] * len(words(text))
    for i in hit_words:
        flags[i] = True
    return flags


def _spans_of(text, hit_words):
    if hit_words is None:
        return []
    raw = text.encode()
    return [{"start": s["start"], "end": s["end"]} for s in _spans(raw, _flags(raw, hit_words))]


def _without(text, hit_words):
    return text if hit_words is None else cut(text, [(s["start"], s["end"]) for s in _spans_of(text, hit_words)])
