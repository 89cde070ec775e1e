"""Vectors as array<double> columns; everything but the embedder is built from higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 where a vector is zero, null where lengths differ."""
    size = norm(a) * norm(b)
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(size, F.lit(0.0))))
    return F.when(F.size(a) == F.size(b), F.when(size == 0, 0.0).otherwise(value))


def normalized(a: Column) -> Column:
    """Length one; a zero vector stays."""
    size = norm(a)
    return F.when(size == 0, a).otherwise(F.transform(a, lambda x: x / size))


def is_valid(a: Column, dimension: int | Column) -> Column:
    """The right length, finite, not all zero."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(a) == dimension) & finite & F.exists(a, lambda x: x != 0), F.lit(False))


def encode(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))


def decode(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def hashed_embedding(text: Column, dimension: int = 64) -> Column:
    """A deterministic offline embedder: signed counts of hashed words, length one.

    Words and their slots are built-in expressions, worked out once a text; a batch of slots is counted by numpy.
    """

    def counted(slots):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.list_value_length(slots), 0).to_numpy()
        at = np.repeat(np.arange(len(slots)), sizes) * (2 * dimension) + slots.flatten().to_numpy()
        found = np.bincount(at, minlength=len(slots) * 2 * dimension).reshape(-1, 2 * dimension)
        counts = (found[:, :dimension] - found[:, dimension:]).astype(float)
        size = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        unit = np.divide(counts, size, out=counts, where=size > 0)
        # A null text has null components.
        return pa.array(list(unit), pa.list_(pa.float64())) if not slots.null_count else pa.array([u if s else [None] * dimension for u, s in zip(unit.tolist(), slots.is_valid().to_pylist(), strict=True)], pa.list_(pa.float64()))

    words = F.split(F.lower(F.trim(text)), r"\s+")
    return F.arrow_udf(counted, "array<double>")(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(2 * dimension)).cast("int")))
