"""Insert and upsert of streams into a table of files, exactly once.

A micro-batch is written into the partition of its number, which it replaces, and then entered into a ledger of one small
file a batch. A batch that is run again, after a failure at any point, writes the same partition and the same entry; a reader
takes the partitions in the ledger alone, so half a batch is never seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def writer(path: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("_batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(f"{path}/rows")
        entry = batch.sparkSession.range(1).select(F.lit(number).cast("long").alias("number"))
        entry.coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/{number:010}")

    return write


def committed(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of the batches in the ledger with their number, _batch."""
    ledger = spark.read.schema("number long").parquet(f"{path}/ledger/*").select(F.col("number").alias("_batch"))
    rows = spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.withColumn("_batch", F.col("_batch").cast("long")).join(F.broadcast(ledger.distinct()), "_batch", "left_semi")


def inserted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key: insert, and ignore what is there; within a batch the first by all columns."""
    others = [c for c in rows.columns if c not in keys and c != "_batch"]
    first = rows.groupBy(*keys).agg(F.min(F.struct("_batch", *others)).alias("_row"))
    return first.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


def upserted(rows: DataFrame, keys: list[str], latest: str | None = None) -> DataFrame:
    """The last row of each key: that of the last batch, within it the one with the largest `latest`, ties by all columns."""
    others = [c for c in rows.columns if c not in keys and c != "_batch"]
    last = rows.groupBy(*keys).agg(F.max(F.struct("_batch", *([F.col(latest).alias("_latest")] if latest else []), *others)).alias("_row"))
    return last.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])

