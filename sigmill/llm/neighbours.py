"""Operator 3: approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length one, where the smallest Euclidean distance is the
largest cosine. A table hashes a vector by K Gaussian projections cut into
slots of one width. A query visits a table's buckets in the order of the
estimated chance that a neighbour at distance `REACH` fell there (the product
of Gaussian slot probabilities around its own projections), until the chances
add up to `SUCCESS`. Candidates of all tables are reranked by their exact
cosine in double precision.

K grows with the logarithm of the table's size; nothing is fitted on the data.
Rows with the same vector are one class, of which the `k + 1` smallest ids are
kept: no query can need more of them. Buckets over `CANDIDATE_BLOCK` candidates
are cut into blocks, and blocks are dealt to groups of about `GROUP` candidates.
Probes travel as bucket numbers; a query's vector goes once to each group that
it probes, where it streams past the group's candidates, and the best few leave
the task. A query that met fewer than k rows, or whose chances did not reach
`SUCCESS` within `MAX_PROBES` buckets, is searched again over all blocks,
exactly; how many these are is logged.

Defined cases: vectors that are null, zero, or hold null or non-finite
components, rows with a null id and vectors of another length than that of the
smallest valid id take no part; rows repeating an id and vector count once; ties
go to the smaller id; fewer candidates than k are all returned.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.blocks import large_keys, with_blocks
from .common import checkpoint

K_NEAREST = 5
TABLES = 2
WIDTH = 1.5
REACH = 1.1
SUCCESS = 0.8
MAX_PROBES = 4096
SEED = 7
CANDIDATE_BLOCK = 4096
GROUP = 8192
#: Queries that are compared with a group's candidates at a time.
QUERY_BLOCK = 1024

_LOG = logging.getLogger(__name__)


def projections(dimension: int, count: int, table: int, seed: int = SEED):
    """(directions, shifts) of one table."""
    import numpy as np

    rng = np.random.default_rng([seed, table])
    return rng.standard_normal((dimension, count)), rng.uniform(0, WIDTH, count)


def _mixed(key, slot):
    """Folds one more slot number into 64-bit bucket keys; rare clashes only add candidates."""
    import numpy as np

    return (key ^ slot.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x7F4A7C15)


def buckets(unit, directions, shifts):
    """The bucket of each row."""
    import numpy as np

    slots = np.floor((unit @ directions + shifts) / WIDTH)
    key = np.zeros(len(unit), np.uint64)
    for k in range(slots.shape[1]):
        key = _mixed(key, slots[:, k])
    return key.view(np.int64)


def probes(unit, directions, shifts, success: float = SUCCESS):
    """(row, bucket, reached) arrays: each row's buckets, likeliest first, until their chances reach `success`; reached by row."""
    import numpy as np

    at = (unit @ directions + shifts) / WIDTH
    home = np.floor(at)
    offsets = np.arange(-4, 5)
    edge = (home[:, :, None] + np.arange(-4, 6) - at[:, :, None]) * (WIDTH / REACH)
    below = 0.5 * (1 + np.vectorize(math.erf)(edge / math.sqrt(2)))
    chance = np.log(np.maximum(np.diff(below, axis=2), 1e-300))
    keys, score = np.zeros((len(unit), 1), np.uint64), np.zeros((len(unit), 1))
    # The best products of k + 1 slots extend the best products of k.
    for k in range(home.shape[1]):
        slots = home[:, k, None, None] + offsets
        keys = _mixed(keys[:, :, None], np.broadcast_to(slots, (len(unit), keys.shape[1], len(offsets))).copy()).reshape(len(unit), -1)
        score = (score[:, :, None] + chance[:, k, None, :]).reshape(len(unit), -1)
        best = np.argsort(-score, axis=1, kind="stable")[:, :MAX_PROBES]
        keys, score = np.take_along_axis(keys, best, 1), np.take_along_axis(score, best, 1)
    wanted = (np.cumsum(np.exp(score), axis=1) < success).sum(axis=1) + 1
    take = np.arange(keys.shape[1]) < np.minimum(wanted, keys.shape[1])[:, None]
    return np.nonzero(take)[0], keys[take].view(np.int64), wanted <= keys.shape[1]


def _candidates(dimension: int, count: int, tables: int):
    """(t, bucket, id, vec) of each candidate."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        shapes = [projections(dimension, count, t) for t in range(tables)]
        for batch in batches:
            for i in range(0, batch.num_rows, 8192):
                part = batch.slice(i, 8192)
                unit = _units(part, dimension)
                for t, shape in enumerate(shapes):
                    arrays = [pa.array(np.full(len(unit), t, np.int32)), pa.array(buckets(unit, *shape)), part.column(0), part.column(1)]
                    yield pa.RecordBatch.from_arrays(arrays, ["t", "bucket", "id", "vec"])

    return run


def _probes(dimension: int, count: int, tables: int):
    """(t, bucket, id) of each bucket that a query visits; (-1, 0, id) for a query whose chances fall short."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        shapes = [projections(dimension, count, t) for t in range(tables)]
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                unit, ids = _units(part, dimension), part.column(0)
                for t, shape in enumerate(shapes):
                    rows, keys, reached = probes(unit, *shape)
                    missed = np.flatnonzero(~reached)
                    kind = np.concatenate([np.full(len(rows), t, np.int32), np.full(len(missed), -1, np.int32)])
                    keys = np.concatenate([keys, np.zeros(len(missed), np.int64)])
                    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(keys), ids.take(pa.array(np.concatenate([rows, missed])))], ["t", "bucket", "id"])

    return run


def _units(part, dimension: int):
    import numpy as np

    vec = part.column(1).flatten().to_numpy().reshape(-1, dimension)
    return vec / np.linalg.norm(vec, axis=1, keepdims=True)


def best_of(asked, found, ids, pairs, keep: int):
    """(query, candidate, score) arrays with the best `keep` candidates of each query, nearest first, ties to the smaller id.

    asked, found: matrices of original vectors; ids: the candidates' ids; pairs: (queries, first, last + 1) of candidates that
    these queries meet.
    """
    import numpy as np

    norms, sizes = np.sqrt((asked * asked).sum(axis=1)), np.sqrt((found * found).sum(axis=1))
    left, right = asked / norms[:, None], found / sizes[:, None]
    qs, cs = [], []
    for queries, i, j in pairs:
        rough = left[queries] @ right[i:j].T
        m = min(keep, j - i)
        floor = np.partition(rough, j - i - m, axis=1)[:, j - i - m, None] - 1e-9
        a, b = np.nonzero(rough >= floor)
        qs.append(queries[a])
        cs.append(b + i)
    if not qs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    q, c = np.concatenate(qs), np.concatenate(cs)
    # A candidate that several tables bring counts once.
    _, once = np.unique(np.stack([q, ids[c]]), axis=1, return_index=True)
    q, c = q[once], c[once]
    exact = np.minimum(1.0, np.maximum(-1.0, (asked[q] * found[c]).sum(axis=1) / (norms[q] * sizes[c])))
    order = np.lexsort((ids[c], -exact, q))
    q, c, exact = q[order], c[order], exact[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < keep], c[place < keep], exact[place < keep]


def _nearest(dimension: int, keep: int):
    """Sorted rows of groups: a group's candidates (kind 0) are held, and its queries (kind 1) stream past them."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        group, parts, held = None, [], None

        def settled():
            rows = pa.Table.from_batches(parts).combine_chunks()
            codes = np.stack([rows.column(n).to_numpy() for n in ("t", "bucket", "c")], axis=1)
            order = np.lexsort(codes.T[::-1])
            codes = codes[order]
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(codes, axis=0) != 0).any(axis=1)) + 1, [len(codes)]])
            vec = rows.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, dimension)
            places = {tuple(codes[i].tolist()): (i, j) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)}
            return places, rows.column("id").to_numpy()[order], vec[order]

        def results(rows):
            places, ids, found = held
            asked = rows.column(rows.schema.get_field_index("vec")).flatten().to_numpy().reshape(-1, dimension)
            mine = rows.column(rows.schema.get_field_index("id")).to_numpy()
            meets: dict = {}
            for q, visited in enumerate(rows.column(rows.schema.get_field_index("visits")).to_pylist()):
                for v in visited:
                    at = places.get((v["t"], v["bucket"], v["c"]))
                    if at is not None:
                        meets.setdefault(at, []).append(q)
            q, c, score = best_of(asked, found, ids, [(np.array(qs), i, j) for (i, j), qs in meets.items()], keep)
            return pa.RecordBatch.from_arrays([pa.array(mine[q]), pa.array(ids[c]), pa.array(score)], ["asked", "found", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            g, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(g) != 0) | (np.diff(kind) != 0)) + 1, [len(g)]])
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if g[i] != group:
                    group, parts, held = g[i], [], None
                if kind[i] == 0:
                    parts.append(batch.slice(i, j - i))
                elif parts:
                    held = held or settled()
                    for k in range(i, j, QUERY_BLOCK):
                        yield results(batch.slice(k, min(QUERY_BLOCK, j - k)))

    return run


def _meet(visits: DataFrame, asked: DataFrame, found: DataFrame, groups: int, dimension: int, keep: int) -> DataFrame:
    """(asked, found, score): for each group, the best `keep` candidates of each query in the buckets that it visits.

    visits: t, bucket, id of a query; asked: id, vec; found: t, bucket, id, vec.
    """
    keys = ["t", "bucket"]
    large = large_keys(found.select(*keys, "id"), keys, CANDIDATE_BLOCK, "cs")
    block = F.pmod(F.xxhash64(F.lit(1), "id"), F.col("cs")).cast("int")
    group = F.pmod(F.xxhash64("t", "bucket", "c"), F.lit(groups)).cast("int").alias("g")
    visit = "array<struct<t:int,bucket:bigint,c:int>>"
    candidates = with_blocks(found, large, keys, "id", "cs").withColumn("c", block)
    candidates = candidates.select(group, F.lit(0).alias("kind"), "t", "bucket", "c", "id", "vec", F.lit(None).cast(visit).alias("visits"))
    every = F.explode(F.sequence(F.lit(0), F.col("cs") - 1))
    each = with_blocks(visits, large, keys, "id", "cs").withColumn("c", every).select(group, "t", "bucket", "c", "id")
    # A query's visits to one group, at most its probes, meet in a row.
    listed = each.groupBy("g", "id").agg(F.collect_list(F.struct("t", "bucket", "c")).alias("visits"))
    none = [F.lit(0).alias("t"), F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("c")]
    queries = listed.join(asked, "id").select("g", F.lit(1).alias("kind"), *none, "id", "vec", F.col("visits").cast(visit).alias("visits"))
    dealt = candidates.unionByName(queries).repartition("g").sortWithinPartitions("g", "kind", "id")
    return dealt.mapInArrow(_nearest(dimension, keep), "asked long, found long, score double")


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vec) of the rows that take part; vec is an array of doubles."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False))).filter(F.exists("vec", lambda x: x != 0))


def search(vectors: DataFrame, is_query, k: int = K_NEAREST, tables: int = TABLES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row with is_query(id column)."""
    rows = usable(vectors, id_col, vector_col)
    first = rows.agg(F.min_by(F.size("vec"), "id").alias("d")).first()
    if first.d is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension, keep = first.d, k + 1
    rows = rows.filter(F.size("vec") == dimension)
    place = F.row_number().over(W.partitionBy("vec").orderBy("id"))
    least = rows.distinct().withColumn("place", place).filter(F.col("place") <= keep)
    classes = checkpoint(least.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "vec", "ids"))
    queries = rows.filter(is_query(F.col("id"))).distinct()
    asked = checkpoint(queries.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec"))
    total = classes.count()
    count = max(2, round(math.log2(max(total, 2)) / 4))
    groups = -(-total * tables // GROUP)

    visits = checkpoint(asked.mapInArrow(_probes(dimension, count, tables), "t int, bucket long, id long"))
    candidates = classes.select("id", "vec").mapInArrow(_candidates(dimension, count, tables), "t int, bucket long, id long, vec array<double>")
    near = checkpoint(_meet(visits.filter("t >= 0"), asked, candidates, groups, dimension, keep))
    met = near.groupBy("asked").agg(F.countDistinct("found").alias("n")).filter(F.col("n") >= min(keep, total)).select(F.col("asked").alias("id"))
    # Within a group a query keeps `keep` classes, so a short list means that few were met at all.
    missed = visits.filter("t < 0").select("id").distinct()
    short = checkpoint(asked.select("id").join(met.join(missed, "id", "left_anti"), "id", "left_anti"))
    if number := short.count():
        _LOG.warning("%d queries met too few rows and are searched over all %d", number, total)
        blocks = -(-total // CANDIDATE_BLOCK)
        everywhere = short.select(F.lit(-1).alias("t"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).cast("long").alias("bucket"), "id")
        spread = classes.select(F.lit(-1).alias("t"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long").alias("bucket"), "id", "vec")
        near = near.unionByName(_meet(everywhere, asked, spread, groups, dimension, keep))
    ranked = near.groupBy("asked", "found").agg(F.max("score").alias("score"))
    best = W.partitionBy("asked").orderBy(F.col("score").desc(), "found")
    ranked = ranked.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= keep)
    members = ranked.join(classes.select(F.col("id").alias("found"), "ids"), "found").select("asked", F.explode("ids").alias("vec_id"), "score")
    owners = queries.join(asked.select(F.col("id").alias("asked"), "vec"), "vec").select(F.col("id").alias("query_id"), "asked")
    # At most keep * keep rows for each query.
    final = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        owners.join(members, "asked")
        .filter("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(final))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
