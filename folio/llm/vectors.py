"""What both vector operators need: which vectors take part, and classes of equal vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import spool


def takes_part(vector: Column) -> Column:
    """True for vectors that are neither null nor zero nor hold null or non-finite components."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def hashed(vector: Column, *more: Column) -> list[Column]:
    """Two independent 64-bit hashes of a vector (and what else must be equal)."""
    return [F.xxhash64(*more, vector).alias("h1"), F.xxhash64(F.lit(1), vector, *more).alias("h2")]


def classes(rows: DataFrame, name: str) -> DataFrame:
    """(node, h1, h2, label, vector, first, n): one row per distinct (label, vector) of (vec_id, label, vector, h1, h2)."""
    met = rows.groupBy("h1", "h2", "label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    return spool(met.withColumn("node", F.monotonically_increasing_id()), name)


def stacked(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
