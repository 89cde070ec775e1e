"""Operator 11: conversations as a succinct trie of their turn prefixes.

A node is a distinct sequence of first turns (role and text); its key is a
128-bit hash chained along the turns, made while a conversation streams through
a task. Nodes are counted by partial sums, so a first turn that a third of all
conversations share is one row early on.

The trie is cut by how many conversations pass a node. Tier 0 holds the nodes of
at most `MEMBERS` conversations, tier 1 those of at most `MEMBERS` squared, and
so on; a shard is a connected part of one tier, named by its topmost node, so it
has at most `MEMBERS` nodes a level. A task builds the level order of its shards
with numpy: a LOUDS bit vector (for each node a one for each child, then a
zero), label arrays in the same order, and sums from the last level up with
add.at. The upper tiers take the sums of the shards below them and are built
likewise, each in a pass of its own.

Defined cases: rows without conv_id are left out; null roles and texts are
empty; turns that tie are ordered by role and text; repeated rows are turns of
their own; a conversation without turns is a member of the root alone; an empty
table has no nodes, not even the root. Other columns of the table are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.blocks import BROADCAST_KEYS, SALTS
from .common import checkpoint, crc_mod, runs, utf8

#: Conversations of a node in the lowest tier; the next ones hold this many times as many.
MEMBERS = 4096
#: Conversation ids that are joined in one group are those of one range of 2 to this power.
ID_BITS = 12
PERIOD = 20
HEADS = 4
TIERS = 5

_KEY = ("k0", "k1")
_PARENT = ("p0", "p1")
_PATH = "conv_id long, depth long, k0 long, k1 long, p0 long, p1 long, words long, ends boolean"
_NODE = "conv_id long, depth long, k0 long, k1 long, p0 long, p1 long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, top boolean"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns in order from place 1, and for each conversation a row of place 0."""
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = rows.select("conv_id", F.row_number().over(order).cast("long").alias("place"), "role", "text")
    return placed.unionByName(rows.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("place"), F.lit("").alias("role"), F.lit("").alias("text")))


def shared_heads(rows: DataFrame, period: int = PERIOD, heads: int = HEADS) -> DataFrame:
    """`turns` whose first h turns are those of the conversation whose id is the next lower multiple of period.

    h is crc32 of the id's text modulo heads; fewer turns are taken if there are fewer, none if that conversation is absent.
    """
    h = crc_mod("conv_id", heads)
    own = rows.filter((F.col("place") == 0) | (F.col("place") > h)).withColumn("place", F.when(F.col("place") > 0, F.col("place") + heads).otherwise(0))
    given = rows.filter((F.col("conv_id") % period == 0) & F.col("place").between(1, heads - 1))
    taken = rows.filter("place = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % period).alias("giver"), h.alias("h"))
    begun = taken.join(given.withColumnRenamed("conv_id", "giver"), "giver").filter("place <= h")
    return own.unionByName(begun.select("conv_id", "place", "role", "text"))


def paths(rows: DataFrame) -> DataFrame:
    """_PATH: a row for each conversation and node on its path; ends: it is the conversation's last."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        names = [c.split()[0] for c in _PATH.split(", ")]
        conv, depth, key, held = None, 0, b"", None

        def signed(digest):
            return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)

        def frame(out):
            kinds = [pa.int64()] * 7 + [pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            out = []
            ids, places = (batch.column(n).to_pylist() for n in ("conv_id", "place"))
            for c, place, role, text in zip(ids, places, utf8(batch, "role"), utf8(batch, "text"), strict=True):
                if held is not None:
                    out.append((*held, c != conv))
                before = key if c == conv else bytes(16)
                conv, depth = c, depth + 1 if place else 0
                key = xxhash.xxh3_128_digest(before + len(role).to_bytes(8, "little") + role + text) if place else bytes(16)
                held = (c, depth, *signed(key), *signed(before), len(text.split()))
            if out:
                yield frame(out)
        if held is not None:
            yield frame([(*held, True)])

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(run, _PATH)


def _attach(rows: DataFrame, few: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """rows with the columns of a materialised `few` of unique keys; broadcast if it has few rows, else joined by a salted key."""
    if few.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(few), list(keys), "left")
    spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, [*keys, "_salt"], "left").drop("_salt")


def _sharded(found: DataFrame) -> DataFrame:
    """found (a path with tier) and the key (r0, r1) of the topmost node of its tier on its path."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, tier, k0, k1 = (batch.column(n).to_numpy() for n in ("conv_id", "tier", *_KEY))
            new = np.concatenate([[True], (np.diff(conv) != 0) | (np.diff(tier) != 0)])
            new[0] = last is None or last[:2] != (conv[0], tier[0])
            at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            roots = [np.where(at < 0, last[2 + i] if last else 0, k[at]) for i, k in enumerate((k0, k1))]
            last = conv[-1], tier[-1], roots[0][-1], roots[1][-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, roots)], [*batch.schema.names, "r0", "r1"])

    return found.repartition("conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(run, f"{_PATH}, tier int, r0 long, r1 long")


class Louds:
    """Level-order unary degree sequence of a forest under a root of its own, 0; nodes are 1 to n in level order."""

    def __init__(self, parents):
        import numpy as np

        self.n = len(parents)
        degrees = np.bincount(parents, minlength=self.n + 1)
        bits = np.ones(2 * self.n + 1, np.uint8)
        bits[np.cumsum(degrees) + np.arange(self.n + 1)] = 0
        self.bits = np.packbits(bits)

    def plain(self):
        import numpy as np

        return np.unpackbits(self.bits, count=2 * self.n + 1)

    def parents(self):
        """Zeros before each node's one: the number of the node whose children it is among."""
        import numpy as np

        return np.flatnonzero(self.plain()) - np.arange(self.n)

    def children(self):
        """(first, number) of each node's children, the root's first."""
        import numpy as np

        zeros = np.flatnonzero(self.plain() == 0)
        counts = np.diff(zeros, prepend=-1) - 1
        return 1 + np.cumsum(counts) - counts, counts


def level_order(keys, parents, roots, labels):
    """(order, parents, levels): rows of a forest in level order, each one's parent as a node number, and where the levels end.

    keys and parents are pairs of arrays; the rows whose key is their root's are the topmost. Siblings are ordered by label.
    """
    import numpy as np

    n = len(labels)
    kind = np.dtype([("a", np.int64), ("b", np.int64)])
    own, up, root = (np.rec.fromarrays(x, dtype=kind) for x in (keys, parents, roots))
    _, codes = np.unique(np.concatenate([own, up]), return_inverse=True)
    where = np.full(codes.max(initial=0) + 1, -1)
    where[codes[:n]] = np.arange(n)
    above = np.where(own == root, -1, where[codes[n:]])
    depth = np.full(n, -1)
    # Depth within the shard, from the top, one level a step.
    front, level, number, order, up_numbers, ends = np.flatnonzero(above < 0), 0, np.zeros(n, np.int64), [], [], []
    by_parent = np.argsort(above, kind="stable")
    first = np.searchsorted(above[by_parent], np.arange(-1, n))
    last = np.searchsorted(above[by_parent], np.arange(-1, n), side="right")
    done = 0
    while len(front):
        over = np.where(above[front] < 0, 0, number[above[front]])
        sorted_ = np.lexsort((labels[front], over))
        front, over = front[sorted_], over[sorted_]
        number[front] = done + 1 + np.arange(len(front))
        depth[front] = level
        done += len(front)
        level += 1
        order.append(front)
        up_numbers.append(over)
        ends.append(done)
        low, sizes = first[front + 1], last[front + 1] - first[front + 1]
        at = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        front = by_parent[at]
    return np.concatenate(order), np.concatenate(up_numbers), ends


def _build(batches):
    import numpy as np
    import pyarrow as pa

    names = [c.split()[0] for c in _NODE.split(", ")]
    for table in runs(batches, ("r0", "r1")):
        columns = {n: table.column(n).to_numpy() for n in table.column_names}
        pair = lambda a, b: (columns[a], columns[b])
        order, parents, ends = level_order(pair(*_KEY), pair(*_PARENT), pair("r0", "r1"), columns["conv_id"])
        labels = {n: c[order] for n, c in columns.items()}
        trie = Louds(parents)
        above = trie.parents()
        _, children = trie.children()
        n_children = children[1:] + labels["more_children"]
        saved = np.concatenate([[0], (labels["n_convs"] - 1) * labels["words"] + labels["more_saved"]])
        leaves = np.concatenate([[0], np.where(n_children == 0, 1, labels["more_leaves"])])
        for low, high in list(zip([0, *ends[:-1]], ends, strict=True))[::-1]:
            for total in (saved, leaves):
                np.add.at(total, above[low:high], total[1 + low : 1 + high])
        top = above == 0
        over = pa.array(np.where(top, 0, labels["conv_id"][above - 1]), mask=top)
        made = {"parent_conv_id": over, "n_children": n_children, "n_leaves": leaves[1:], "saved_tokens": saved[1:], "top": top}
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (made.get(n, labels.get(n)) for n in names)], names)


def ending(found: DataFrame) -> DataFrame:
    """(k0, k1, ends_sha256): SHA-256 of the ids of the conversations that end at a node, ascending, comma-joined.

    Ids are joined in groups of a range of ids; a task streams a node's groups through one digest.
    """
    grouped = found.filter("ends").groupBy(*_KEY, F.shiftright("conv_id", ID_BITS).alias("range")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    joined = grouped.select(*_KEY, "range", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def run(batches):
        import pyarrow as pa

        node, digest = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(n).to_pylist() for n in (*_KEY, "ids")), strict=True):
                if key == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*_KEY, "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, digest.hexdigest())], [*_KEY, "ends_sha256"])

    return joined.repartition(*_KEY).sortWithinPartitions(*_KEY, "range").mapInArrow(run, "k0 long, k1 long, ends_sha256 string")


def trie(rows: DataFrame, members: int = MEMBERS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of `turns`.

    conv_id is the smallest member; with the depth it names the node.
    """
    found = checkpoint(paths(rows))
    tier = sum((F.col("count") > members**i).cast("int") for i in range(1, TIERS + 1))
    heavy = checkpoint(found.groupBy(*_KEY).count().filter(F.col("count") > members).select(*_KEY, tier.alias("tier")))
    tiered = _attach(found, heavy, _KEY).select(*found.columns, F.coalesce("tier", F.lit(0)).alias("tier"))
    same = [F.first(c).alias(c) for c in ("depth", "words", "tier", *_PARENT, "r0", "r1")]
    nodes = checkpoint(_sharded(tiered).groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *same))

    below = nodes.sparkSession.createDataFrame([], "k0 long, k1 long, more_children long, more_leaves long, more_saved long")
    parts = []
    for level in range(1 + (heavy.agg(F.max("tier")).first()[0] or 0)):
        part = nodes.filter(F.col("tier") == level)
        part = part.join(below, list(_KEY), "left").fillna(0, ["more_children", "more_leaves", "more_saved"])
        parts.append(checkpoint(part.repartition("r0", "r1").sortWithinPartitions("r0", "r1").mapInArrow(_build, _NODE)))
        tops = parts[-1].filter("top").groupBy(*_PARENT)
        sums = tops.agg(F.count("*").alias("more_children"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        sums = sums.withColumnsRenamed(dict(zip(_PARENT, _KEY, strict=True)))
        below = below.unionByName(sums).groupBy(*_KEY).agg(*(F.sum(c).alias(c) for c in ("more_children", "more_leaves", "more_saved")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    upper = checkpoint(nodes.filter("tier > 0").select(F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv_id").alias("over")))
    whole = _attach(every, upper, _PARENT).join(ending(found), list(_KEY), "left")
    return whole.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "over")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
