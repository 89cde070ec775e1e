"""Operator 13: removal of every byte that a repeated string of `WIDTH` bytes covers, by suffix arrays of shards.

Equal strings must meet in one shard, and text that repeats nothing should meet nobody. So every window of `WIDTH` bytes
has an anchor: of the substrings of `WIDTH - SPAN + 1` bytes that begin in it, the one with the least hash, the first of
equals. Equal windows have equal anchors at equal offsets. The consecutive windows of one anchor are its context; contexts
divide a document's windows.

    1  A task cuts its documents into contexts and keeps, of the equal ones, the earliest; the rest is covered.
    2  Contexts meet by anchor, in a sorted stream. Of equal contexts the earliest stays, the rest is covered; an anchor
       with one context is done.
    3  Contexts of anchors that have several go to the shard of their anchor, with their text. A shard's texts are sorted
       as one string (module `induced`); suffixes that have `WIDTH` bytes and more in common with their neighbours are
       equal windows, and all but the earliest are covered. An anchor of more than `HOT` contexts is spread over all
       shards: its windows go one by one, by their own hash.
    4  A document's covered ranges are joined to its text and cut out.

A shard's task holds `memory` bytes of the sort's queues; what outgrows them goes to files of the task.

Documents are ordered by doc_id, null last; rows that share a doc_id by the 64-bit hash of their texts; rows equal in both
are one document, so they don't repeat each other, and each of them gets the same result.

Defined cases: null and empty texts have no bytes; texts under `WIDTH` bytes keep all; overlapping strings count, also
within one document; an empty table gives no rows. Other columns of the table are not read.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import large_keys, with_blocks
from .common import checkpoint, utf8
from .induced import SEPARATOR, Store, ordered

WIDTH = 100
SPAN = 50
#: Bytes of text in one shard, and of memory for the queues of its sort.
SHARD = 4 << 20
MEMORY = 128 << 20
#: Contexts of one anchor in one shard.
HOT = 20_000
_BLOCK = 1 << 16
_LAST = 2**63 - 1

_FOUND = "key long, ctx long, doc long, tag long, at int, size int"
_RANGE = "doc long, tag long, at int, size int"


@cache
def _powers():
    """A random number for each byte, and the powers of an odd number and of its inverse modulo 2 to the 64."""
    import numpy as np

    random = np.random.default_rng(13)
    odd = int(random.integers(0, 2**64, dtype=np.uint64)) | 5
    n = _BLOCK + 4096
    up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (odd, pow(odd, -1, 2**64)))
    return random.integers(0, 2**64, 256, np.uint64), up, down


def contexts(text: bytes, width: int = WIDTH, span: int = SPAN):
    """(key, start, count) arrays: the anchor's hash, the first window and the number of windows of each context, in order."""
    import numpy as np

    table, up, down = _powers()
    data, k = np.frombuffer(text, np.uint8), width - span + 1
    out = []
    for low in range(0, len(data) - width + 1, _BLOCK):
        part = data[low : low + _BLOCK + width - 1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[part] * up[: len(part)])])
        hashed = (sums[k:] - sums[:-k]) * down[: len(part) - k + 1]
        hashed ^= hashed >> np.uint64(31)
        hashed *= np.uint64(0xBF58476D1CE4E5B9)
        hashed ^= hashed >> np.uint64(29)
        # The place fills the low bits, so the least value is the first place of the least hash.
        least = (hashed >> np.uint64(20) << np.uint64(20)) | np.arange(len(hashed), dtype=np.uint64)
        done = 1
        while done < span:
            step = min(done, span - done)
            least = np.minimum(least[: len(least) - step], least[step:])
            done += step
        place = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
        start = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        out.append((hashed[place[start]].view(np.int64), low + start, np.diff(start, append=len(place))))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def merged(owner, start, end):
    """Ranges of each owner, sorted, those that touch or overlap as one."""
    import numpy as np

    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    if not len(owner):
        return owner, start, end
    # Ends grow within an owner once lifted over those of the owners before.
    lift = np.concatenate([[0], np.cumsum(owner[1:] != owner[:-1])]) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    new = np.concatenate([[True], start[1:] + lift[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(owner)]]) - 1
    return owner[at], start[at], (reach - lift)[last]


def _cut(width: int, span: int):
    """_FOUND: contexts with their number of windows as size; ranges already covered with their length, negative, as size."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows = []
            for i, text in enumerate(utf8(batch, "text")):
                key, start, count = contexts(text, width, span)
                if len(key):
                    end = start + count + width - 1
                    ctx = np.fromiter((digest(text[a:b], i) for a, b, i in zip(start.tolist(), end.tolist(), count.tolist(), strict=True)), np.uint64, len(key))
                    rows.append((key, ctx.view(np.int64), np.full(len(key), i), start, count))
            if not rows:
                continue
            key, ctx, row, at, size = (np.concatenate(c) for c in zip(*rows, strict=True))
            _, kind, often = np.unique(key * 0x9E3779B97F4A7C5 + ctx, return_inverse=True, return_counts=True)
            twice = np.flatnonzero(often[kind] > 1)
            twice = twice[np.lexsort((at[twice], tags[row[twice]], ids[row[twice]], ctx[twice], key[twice]))]
            k, c, r = key[twice], ctx[twice], row[twice]
            again = np.zeros(len(key), bool)
            same = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
            head = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(twice)), 0)) if len(twice) else twice
            one = (ids[r] == ids[r[head]]) & (tags[r] == tags[r[head]]) & (at[twice] == at[twice[head]])
            again[twice] = ~one
            owner, start, end = merged(row[again], at[again], (at + size + width - 1)[again])
            # The ranges travel by a number of their own, and pass the stream of contexts as they are.
            passing = (owner * 0x9E3779B97F4A7C5 + start) ^ ids[owner]
            columns = [(key[~again], passing), (ctx[~again], np.zeros(len(owner), np.int64)), (ids[row[~again]], ids[owner]), (tags[row[~again]], tags[owner])]
            columns = [np.concatenate(c) for c in columns] + [np.concatenate(c).astype(np.int32) for c in ((at[~again], start), (size[~again], start - end))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in _FOUND.split(", ")])

    return run


def _meet(width: int):
    """Of contexts sorted by (key, ctx, doc, tag, at): the first of each ctx if its key has several, with key; the others as covered ranges, key 0."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = [c.split()[0] for c in _FOUND.split(", ")]
        first, sibling = None, False  # the last context that was the first of its kind, and whether its key has one before

        def frame(columns):
            key, _, doc, tag, at, size = columns
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (key, doc, tag, at, size)], ["key", "doc", "tag", "at", "size"])

        for batch in batches:
            columns = [batch.column(n).to_numpy() for n in names]
            ready = columns[5] < 0
            if ready.any():
                yield frame([np.zeros(int(ready.sum()), np.int64), *(c[ready] for c in columns[1:])])
                columns = [c[~ready] for c in columns]
            if not len(columns[0]):
                continue
            carried = first is not None
            if carried:
                columns = [np.concatenate([[f], c]).astype(c.dtype) for f, c in zip(first, columns, strict=True)]
            key, ctx, doc, tag, at, size = columns
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])])
            heads = np.flatnonzero(new)
            head = heads[np.cumsum(new) - 1]
            covered = ~((doc == doc[head]) & (tag == tag[head]) & (at == at[head]))
            if covered.any():
                part = [c[covered] for c in columns]
                yield frame([np.zeros_like(part[0]), *part[1:5], (1 - width - part[5]).astype(np.int32)])
            k = key[heads]
            next_too = np.concatenate([k[1:] == k[:-1], [False]])
            last_too = np.concatenate([[carried and sibling], k[1:] == k[:-1]])
            several = heads[:-1][(next_too | last_too)[:-1]]
            if len(several):
                yield frame([c[several] for c in columns])
            first, sibling = [c[heads[-1]] for c in columns], bool(last_too[-1])
        if first is not None and sibling:
            yield frame([np.array([f]) for f in first])

    return run


def _sliced(width: int, shards: int):
    """The texts of a document's contexts, each with its shard; the windows of a spread anchor one by one."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        names = ["shard", "doc", "tag", "at", "windows", "body"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            out, held = [], 0

            def frame(rows):
                return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

            docs, tags, lists = (batch.column(n) for n in ("doc", "tag", "asked"))
            for i, text in enumerate(utf8(batch, "text")):
                doc, tag = docs[i].as_py(), tags[i].as_py()
                for x in lists[i].as_py():
                    key, at, size = x["key"], x["at"], x["size"]
                    if x["blocks"] == 1:
                        out.append((key % shards, doc, tag, at, size, text[at : at + size + width - 1]))
                    else:
                        for j in range(at, at + size):
                            body = text[j : j + width]
                            out.append((xxhash.xxh3_64_intdigest(body) % shards, doc, tag, j, 1, body))
                    held += size + width
                    if held > 16 << 20:
                        yield frame(out)
                        out, held = [], 0
            if out:
                yield frame(out)

    return run


class Shard:
    """The texts of a shard as one string, with whose they are; parts go to files as they outgrow the memory."""

    def __init__(self, width: int, memory: int):
        self.width, self.memory, self.store = width, memory, Store(memory)
        self.parts, self.rows, self.n = [], [], 0
        self.held, self.mapped = 0, []

    def add(self, doc, tag, at, windows, bodies: bytes):
        """Contexts in order of (doc, tag, at), their texts one after the other."""
        import numpy as np

        size = windows + self.width - 1
        ends = np.cumsum(size)
        codes = np.full(len(bodies) + len(size), SEPARATOR, np.uint16)
        places = np.arange(len(bodies)) + np.repeat(np.arange(len(size)), size)
        codes[places] = np.frombuffer(bodies, np.uint8)
        codes[places] += 2
        self.rows.append((doc, tag, at, windows, self.n + ends - size + np.arange(len(size))))
        self.n += len(codes)
        self.parts.append(codes)
        self.held += codes.nbytes
        if self.held > self.memory // 4:
            mapped = self.store.array(self.held // 2, np.uint16)
            mapped[:] = np.concatenate(self.parts)
            self.mapped.append(mapped)
            self.parts, self.held = [], 0

    def covered(self):
        """(doc, tag, at, size) arrays of the ranges that equal windows of the shard cover but for the earliest."""
        import numpy as np

        width = self.width
        codes = self.store.array(self.n + 1 + width + 40, np.uint16)
        at = 0
        for part in (*self.mapped, *self.parts):
            codes[at : at + len(part)] = part
            at += len(part)
        self.mapped, self.parts = [], []
        hit = self.store.array(self.n + 1, np.bool_)
        for place, value in ordered(codes, self.n + 1, 258, self.memory, width):
            run = np.cumsum(value < width)
            many = np.bincount(run)[run] > 1
            place, run = place[many], run[many]
            if len(place):
                hit[place] = True
                heads = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
                hit[np.minimum.reduceat(place, heads)] = False
        doc, tag, start, windows, begin = (np.concatenate(c) for c in zip(*self.rows, strict=True))
        for low in range(0, len(hit), 1 << 20):
            place = low + np.flatnonzero(hit[low : low + (1 << 20)])
            if not len(place):
                continue
            owner = np.searchsorted(begin, place, side="right") - 1
            inside = place - begin[owner]
            # Strings over a separator are equal in more than one context and are no windows.
            real = inside < windows[owner]
            owner, inside = owner[real], inside[real]
            owner, first, end = merged(owner, inside, inside + 1)
            yield doc[owner], tag[owner], start[owner] + first, 1 - width - (end - first)


def _sorted(width: int, memory: int):
    """_RANGE of rows sorted by (shard, doc, tag, at)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def ranges(shard):
            for doc, tag, at, size in shard.covered():
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tag), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32))], ["doc", "tag", "at", "size"])

        number, shard, last = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers, doc, tag, at = (batch.column(n).to_numpy() for n in ("shard", "doc", "tag", "at"))
            # A row of a document that stands twice in the table comes twice.
            again = np.concatenate([[last == (numbers[0], doc[0], tag[0], at[0])], (np.diff(numbers) == 0) & (np.diff(doc) == 0) & (np.diff(tag) == 0) & (np.diff(at) == 0)])
            last = numbers[-1], doc[-1], tag[-1], at[-1]
            batch = batch.filter(pa.array(~again))
            numbers = numbers[~again]
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if numbers[i] != number:
                    if shard is not None:
                        yield from ranges(shard)
                    number, shard = numbers[i], Shard(width, memory)
                part = batch.slice(i, j - i)
                doc, tag, at, windows = (part.column(n).to_numpy().astype(np.int64) for n in ("doc", "tag", "at", "windows"))
                shard.add(doc, tag, at, windows, b"".join(part.column("body").to_pylist()))
        if shard is not None:
            yield from ranges(shard)

    return run


def _kept(batches):
    import numpy as np
    import pyarrow as pa

    names = ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"]
    for batch in batches:
        out, size = [], 0
        lists = batch.column("ranges")
        for i, text in enumerate(utf8(batch, "text")):
            found = lists[i].as_py() or []
            at, length = (np.array([x[n] for x in found], np.int64) for n in ("at", "size"))
            _, start, end = merged(np.zeros(len(at), np.int64), at, at - length)
            parts, done = [], 0
            for a, b in zip(start.tolist(), end.tolist(), strict=True):
                parts.append(text[done:a])
                done = b
            out.append((b"".join([*parts, text[done:]]), len(text), int((end - start).sum()), len(start)))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        arrays = [pa.array(list(columns[0]), pa.binary()), *(pa.array(list(c), pa.int64()) for c in columns[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), *arrays], names)


def covered(keyed: DataFrame, width: int = WIDTH, span: int = SPAN, shard: int = SHARD, memory: int = MEMORY, hot: int = HOT) -> DataFrame:
    """_RANGE, size negative, of keyed (doc_id, doc, tag, text): ranges that repeated strings cover; they may overlap."""
    cut = keyed.select("doc", "tag", "text").mapInArrow(_cut(width, span), _FOUND)
    stream = cut.repartition("key").sortWithinPartitions("key", "ctx", "doc", "tag", "at")
    found = checkpoint(stream.mapInArrow(_meet(width), "key long, doc long, tag long, at int, size int"))
    ranges = found.filter("size < 0").select("doc", "tag", "at", "size")
    several = found.filter("size > 0")
    n_bytes = several.agg(F.sum(F.col("size") + F.lit(width - 1))).first()[0]
    if not n_bytes:
        return ranges
    asked = with_blocks(several, large_keys(several, ["key"], hot), ["key"], "at")
    lists = asked.groupBy("doc", "tag").agg(F.collect_list(F.struct("key", "at", "size", "blocks")).alias("asked"))
    sliced = keyed.join(lists, ["doc", "tag"]).mapInArrow(_sliced(width, -(-n_bytes // shard)), "shard long, doc long, tag long, at int, windows int, body binary")
    dealt = sliced.repartition("shard").sortWithinPartitions("shard", "doc", "tag", "at")
    return ranges.unionByName(dealt.mapInArrow(_sorted(width, memory), _RANGE))


def deduplicate(docs: DataFrame, width: int = WIDTH, span: int = SPAN, shard: int = SHARD, memory: int = MEMORY, hot: int = HOT) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans) for each row of docs; kept: the bytes that stay.

    width: bytes of a repeated string; span: windows that share an anchor at most, less than width.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc")
    keyed = docs.select("doc_id", doc, F.xxhash64("text").alias("tag"), "text")
    ranges = covered(keyed, width, span, shard, memory, hot).groupBy("doc", "tag").agg(F.collect_list(F.struct("at", "size")).alias("ranges"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed.join(ranges, ["doc", "tag"], "left").mapInArrow(_kept, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long")


def report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs."""
    return deduplicate(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
