"""Operator 7: SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit for the majority of the shingles' 64-bit hashes. Bit i
carries a nonzero 4-bit vector; table v (1 to 15) keeps the bits whose vector
has an odd inner product with v. Any three vectors are orthogonal to some
nonzero v, so two fingerprints that differ in up to three bits agree on all
bits that this table keeps: every pair within the radius collides. Collisions
are then compared exactly.

Documents with one fingerprint form one node, so copies never meet pairwise. A
bucket's fingerprints are compared inside tasks, and only a spanning star of
each connected part leaves a task. Buckets over `BLOCK` fingerprints are cut
into blocks and every pair of blocks is compared in a task of its own. The
parts are joined into components by alternating large-star and small-star
steps, each a few joins, checkpointed.

Defined cases: a null or blank text has fingerprint zero; rows with a null
doc_id have a fingerprint and link others but are never the smallest id; rows
repeating a doc_id get a row each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import placed
from ..operators.graph import components
from .common import checkpoint, runs, starts, utf8

SHINGLE = 3
RADIUS = 3
BITS = 64
#: Fingerprints of one bucket that are compared in one task.
BLOCK = 2048


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The bits that each table keeps."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    import numpy as np
    import xxhash

    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate([[0], ends[:-1]])
    size = min(n, len(tokens))
    pairs = zip(starts[: len(tokens) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)
    hashed = np.array([xxhash.xxh64_intdigest(joined[i:j], 42) for i, j in pairs], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashed), 8192):
        part = np.unpackbits(hashed[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashed), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed long."""
    docs = docs.select("doc_id", "text")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t, n) for t in utf8(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def stars(left, right, radius: int = RADIUS):
    """(root, member) pairs that span the connected parts of left and right together.

    left and right are sorted arrays of distinct fingerprints, the same array or
    disjoint ones; pairs are compared by differing bits, and a part's root is its
    first fingerprint.
    """
    import numpy as np

    alone = left is right
    nodes = left if alone else np.concatenate([left, right])
    bits = nodes.view(np.uint64)
    todo = np.ones(len(nodes), bool)
    side = np.arange(len(nodes)) < len(left)
    out = []
    for root in range(len(nodes)):
        if not todo[root]:
            continue
        todo[root] = False
        front = [root]
        while front:
            at = front.pop()
            open_ = np.flatnonzero(todo if alone else todo & (side != side[at]))
            near = open_[np.bitwise_count(bits[open_] ^ bits[at]) <= radius]
            todo[near] = False
            out += [(root, i) for i in near.tolist()]
            front += near.tolist()
    return [(int(nodes[a]), int(nodes[b])) for a, b in out]


def _compare(radius: int):
    """Groups of consecutive rows with one (v, key, a, b) are compared; a batch's last group waits for the next batch."""

    def small(fps, cuts):
        """All pairs inside groups of up to 32, by distance in sorted order, without a Python loop over groups."""
        import numpy as np

        group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        bits = fps.view(np.uint64)
        found = []
        for d in range(1, int(np.diff(cuts).max(initial=1))):
            near = (group[d:] == group[:-d]) & (np.bitwise_count(bits[d:] ^ bits[:-d]) <= radius)
            found.append(np.stack([fps[:-d][near], fps[d:][near]]))
        return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bucket = ("v", "key", "a", "b")
        for rows in runs(batches, bucket):
            cuts = starts(rows, bucket)
            a, b, side, fp = (rows.column(n).to_numpy() for n in ("a", "b", "side", "fp"))
            sizes = np.diff(cuts)
            plain = (a[cuts[:-1]] == b[cuts[:-1]]) & (sizes <= 32)
            out = [small(fp[np.repeat(plain, sizes)], np.concatenate([[0], np.cumsum(sizes[plain])]))] if plain.any() else []
            for g in np.flatnonzero(~plain):
                i, j = cuts[g], cuts[g + 1]
                if a[i] == b[i]:
                    pairs = stars(own := fp[i:j], own, radius)
                else:
                    pairs = stars(fp[i:j][side[i:j] == a[i]], fp[i:j][side[i:j] == b[i]], radius)
                if pairs:
                    out.append(np.array(pairs, np.int64).T)
            found = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["x", "y"])

    return run


def links(nodes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(x, y) fingerprint pairs that connect all distinct fingerprints within the radius; nodes has distinct fp."""
    tables = F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for v, m in enumerate(masks(radius))])
    keyed = nodes.select("fp", F.explode(tables).alias("t")).select("t.v", "t.key", "fp")
    # Block k of a bucket takes part in the pairs (k, k), (k, later) and (earlier, k); a bucket of one fingerprint gives no link.
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least(k, F.col("side")).alias("a"), F.greatest(k, F.col("side")).alias("b")),
    )
    dealt = (
        placed(keyed, ["v", "key"], "fp", block, ("side", "blocks"))
        .select("v", "key", "side", "fp", F.explode(pairs).alias("p"))
        .select("v", "key", "p.a", "p.b", "side", "fp")
    )
    sorted_ = dealt.repartition("v", "key", "a", "b").sortWithinPartitions("v", "key", "a", "b", "fp")
    return sorted_.mapInArrow(_compare(radius), "x long, y long").distinct()


def near_duplicates(docs: DataFrame, n: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs."""
    return grouped(checkpoint(fingerprints(docs, n)), radius).select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")


def grouped(signed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for materialised (doc_id, fp) rows."""
    nodes = checkpoint(signed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(parts, nodes["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(ids, "root").select("fp", "component_id")
    return signed.join(by_fp, "fp", "left").select("doc_id", "fp", "component_id")


def hex_of(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def one_of_each(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each component of parts (doc_id, digest, component), a row for each of docs.

    The smallest doc_id stays, nulls last, then the smallest digest (md5 of the text), then the smallest of the whole rows as
    JSON. The columns of docs travel in one struct, so their names don't matter.
    """
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "digest")
    counted = parts.groupBy("component", "doc_id", "digest").agg(F.count("*").alias("n"))
    least = counted.groupBy("component").agg(F.min(order).alias("least"), F.min_by("n", order).alias("n"))
    kept = checkpoint(least.select(F.col("least.doc_id").alias("id"), "least.digest", "n"))
    rows = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & F.md5(F.col("row.text").cast("binary")).eqNullSafe(F.col("digest"))
    found = rows.join(kept, same)
    single = found.filter("n = 1").select("row")
    # Equal ids and texts: the first of the rows by all their columns, found with partial minima.
    repeated = found.filter("n > 1").groupBy("id", "digest").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return single.unionByName(repeated).select("row.*")


def keep_one(docs: DataFrame, n: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs, all columns, with one row of each component: the smallest doc_id, a null id only where no row has one."""
    rows = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    found = grouped(checkpoint(fingerprints(rows.select(F.struct("doc_id", "digest").alias("doc_id"), "text"), n)), radius)
    return one_of_each(docs, found.select("doc_id.doc_id", "doc_id.digest", F.col("component_id").alias("component")))


def keep_dissimilar(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each component of a five-word shingle similarity of 0.8 or more (module similar)."""
    from . import similar

    return similar.keep_one(docs)
