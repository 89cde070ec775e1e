"""Comparisons of vectors block by block: rows with equal keys are cut into blocks, and pairs of blocks are dealt to tasks.

A key's rows never meet in one task: keys over a block's size are found by a
count with partial sums, and a row learns its key's number of blocks through a
join that is spread by a salt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint

#: Vectors of one block.
BLOCK = 1024
SALTS = 64
#: Shares to which pairs of blocks of large keys are dealt, at most.
MOST_SHARES = 10_000
#: Percentiles of the ids of a key, of which ranges of ids take their bounds.
PERCENTILES = 1024
#: Large keys up to which their table is broadcast.
BROADCAST_KEYS = 100_000


def large_keys(rows: DataFrame, keys: list[str], size: int, blocks: str = "blocks") -> DataFrame:
    """(keys, blocks) of the keys with more than `size` rows, counted once."""
    large = rows.groupBy(*keys).count().filter(F.col("count") > size)
    return checkpoint(large.select(*keys, F.ceil(F.col("count") / F.lit(size)).cast("int").alias(blocks)))


def with_blocks(rows: DataFrame, large: DataFrame, keys: list[str], row_id: str, blocks: str = "blocks", rest: Column | None = None) -> DataFrame:
    """rows with their key's number of blocks; `rest`, 1 if not given, for keys that are not large.

    A table of at most `BROADCAST_KEYS` large keys is broadcast; a longer one meets the rows in a join spread by a salt.
    """
    if large.count() <= BROADCAST_KEYS:
        joined = rows.join(F.broadcast(large), keys, "left")
    else:
        spread = large.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(SALTS)).cast("int"))
        joined = salted.join(spread, [*keys, "_salt"], "left").drop("_salt")
    return joined.withColumn(blocks, F.coalesce(blocks, F.lit(1) if rest is None else rest))


def _hashed(row_id: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), row_id), F.col(blocks)).cast("int")


def placed(rows: DataFrame, keys: list[str], row_id: str, size: int = BLOCK, names: tuple[str, str] = ("block", "blocks")) -> DataFrame:
    """rows with their block and their key's number of blocks, one block where a key has at most `size` rows."""
    block, blocks = names
    joined = with_blocks(rows, large_keys(rows, keys, size, blocks), keys, row_id, blocks)
    return joined.withColumn(block, _hashed(row_id, blocks))


def ranged(rows: DataFrame, keys: list[str], row_id: str, size: int) -> tuple[DataFrame, int]:
    """rows as `placed`, with blocks of about `size` rows that are ranges of a numeric row_id, and the pairs of blocks of large keys.

    Ids of another kind are dealt by their hash. A key has PERCENTILES blocks at most; beyond, these grow.
    """
    if rows.schema[row_id].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        large = large_keys(rows, keys, size)
        found = with_blocks(rows, large, keys, row_id).withColumn("block", _hashed(row_id, "blocks"))
    else:
        whole = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx(row_id, [i / PERCENTILES for i in range(1, PERCENTILES)]).alias("at"))
        cut = whole.filter(F.col("n") > size).withColumn("blocks", F.least(F.ceil(F.col("n") / F.lit(size)), F.lit(PERCENTILES)).cast("int"))
        bounds = F.transform(F.sequence(F.lit(1), F.col("blocks") - 1), lambda i: F.element_at("at", F.floor(i * PERCENTILES / F.col("blocks")).cast("int")))
        large = checkpoint(cut.select(*keys, "blocks", bounds.alias("bounds")))
        joined = with_blocks(rows, large.drop("blocks"), keys, row_id, "bounds", F.array().cast(large.schema["bounds"].dataType))
        found = joined.withColumn("block", F.size(F.filter("bounds", lambda x: x < F.col(row_id)))).withColumn("blocks", F.size("bounds") + 1).drop("bounds")
    met = large.agg(F.sum(F.col("blocks").cast("long") * (F.col("blocks") + 1) / 2).cast("long")).first()[0]
    return found, met or 0


def _every(blocks: str) -> Column:
    return F.sequence(F.lit(0), F.col(blocks) - 1)


def matrix(table, name: str):
    """A list column of an Arrow table as a matrix of unit rows; a zero vector stays zero."""
    import numpy as np

    if not table.num_rows:
        return np.zeros((0, 1))
    rows = np.concatenate([chunk.flatten().to_numpy() for chunk in table.column(name).chunks]).reshape(table.num_rows, -1)
    sizes = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, sizes, out=np.zeros_like(rows), where=sizes > 0)


def rounded(values, digits: int):
    """Half up, as SQL rounds."""
    import numpy as np

    scale = 10.0**digits
    return np.copysign(np.floor(np.abs(values) * scale + 0.5), values) / scale


def _dealt(placed: DataFrame) -> DataFrame:
    both = F.transform(_every("blocks"), lambda k: F.struct(F.least(k, F.col("block")).alias("a"), F.greatest(k, F.col("block")).alias("b")))
    return placed.withColumn("p", F.explode(both)).withColumn("a", F.col("p.a")).withColumn("b", F.col("p.b")).drop("p", "blocks")


def _sides(table):
    """(left, right, same) of the rows of a pair of blocks."""
    import pyarrow.compute as pc

    a, b = table.column("a")[0], table.column("b")[0]
    left = table.filter(pc.equal(table.column("block"), a))
    return left, left if a == b else table.filter(pc.equal(table.column("block"), b)), a == b


def pairwise(rows: DataFrame, keys: list[str], row_id: str, compare: Callable, schema: str, size: int = BLOCK) -> DataFrame:
    """compare(left, right, same) of every pair of blocks of rows with equal keys, Arrow tables both; same: a block with itself."""

    def run(table):
        return compare(*_sides(table))

    return _dealt(placed(rows, keys, row_id, size)).groupBy(*keys, "a", "b").applyInArrow(run, schema)


def pairwise_ranges(rows: DataFrame, keys: list[str], row_id: str, compare: Callable, schema: str, size: int) -> DataFrame:
    """As `pairwise`, of blocks that are ranges of row_id; compare gives batches one by one, so that a task never holds all its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from compare(*_sides(pa.Table.from_batches(batches)))

    found, met = ranged(rows, keys, row_id, size)
    dealt = _dealt(found)
    if met:
        # Else a few small shares of vectors would be put together, though each becomes many pairs.
        shares = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4 * met, MOST_SHARES))
        dealt = dealt.repartition(shares, *keys, "a", "b")
    return dealt.groupBy(*keys, "a", "b").applyInArrow(run, schema)


def bipartite(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, compare: Callable, schema: str, size: int = BLOCK) -> DataFrame:
    """compare(left, right) of every block of left with every block of right with equal keys.

    left and right have the same columns but for their ids; only keys of both sides are dealt.
    """
    ours = placed(left, keys, left_id, size, ("a", "as")).withColumnRenamed(left_id, "row_id").withColumn("side", F.lit(0))
    theirs = placed(right, keys, right_id, size, ("b", "bs")).withColumnRenamed(right_id, "row_id").withColumn("side", F.lit(1))
    counts = ours.select(*keys, "as").distinct().join(theirs.select(*keys, "bs").distinct(), keys)
    spread = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def met(side: DataFrame, other: str, block: str, own: str) -> DataFrame:
        salted = side.withColumn("_salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int"))
        joined = salted.join(spread.drop(own), [*keys, "_salt"]).drop("_salt", own)
        return joined.withColumn(block, F.explode(_every(other))).drop(other)

    dealt = met(ours, "bs", "b", "as").unionByName(met(theirs, "as", "a", "bs"))

    def run(table):
        import pyarrow.compute as pc

        asked = table.filter(pc.equal(table.column("side"), 0))
        found = table.filter(pc.equal(table.column("side"), 1))
        return compare(asked, found)

    return dealt.groupBy(*keys, "a", "b").applyInArrow(run, schema)
