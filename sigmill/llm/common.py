"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import checkpoint, checkpoint_folder

__all__ = ["WORD_BYTES", "checkpoint", "checkpoint_folder", "crc_mod", "read", "runs", "sized", "utf8"]

#: Maps a byte to itself, A-Z to a-z, and everything that is no ASCII letter, digit or non-ASCII byte to a blank.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(key: str | Column, n: int) -> Column:
    """crc32 of the key's text modulo n; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % n


def sized(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """A materialised frame in partitions of about `rows` rows, so that a small one leaves few shuffle files behind."""
    return df.coalesce(max(1, -(-df.count() // rows)))


def utf8(batch, name: str) -> list[bytes]:
    """A string column of an Arrow batch as UTF-8 bytes; null becomes empty."""
    import pyarrow as pa

    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def runs(batches, names: tuple[str, ...]):
    """Tables of whole runs of consecutive rows that are equal in the columns `names`; a batch's last run waits for the next batch."""
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
        heads = [rows.column(n).to_numpy() for n in names]
        same = np.logical_and.reduce([h == h[-1] for h in heads])
        start = rows.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        held = rows.slice(start)
        if start:
            yield rows.slice(0, start)
    if held is not None:
        yield held


def starts(table, names: tuple[str, ...]):
    """Where the runs of a table begin, and its length."""
    import numpy as np

    heads = [table.column(n).to_numpy() for n in names]
    new = np.flatnonzero(np.logical_or.reduce([np.diff(h) != 0 for h in heads])) + 1
    return np.concatenate([[0], new, [table.num_rows]])
