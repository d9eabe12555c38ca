"""What the operators on vectors share: which vectors count, samples, and arrays of Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(name: str) -> Column:
    """Not null, not zero, every component there and finite."""
    good = F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(good & F.exists(name, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, all of ``dim`` components, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def normed(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaling first keeps squares in range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def dims(df: DataFrame, name: str) -> list[tuple[int, int]]:
    """Numbers of components that occur and how many rows have each."""
    return sorted((r["d"], r["n"]) for r in df.groupBy(F.size(name).alias("d")).agg(F.count("*").alias("n")).collect())


def sample(df: DataFrame, name: str, dim: int, rows: int, most: int) -> np.ndarray:
    """At most ``most`` vectors of ``dim`` components out of ``rows``, chosen by a hash of the vector."""
    of = df.filter(F.size(name) == dim)
    share = min(1.0, 1.2 * most / max(rows, 1))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("vector sample"), name), 11).cast("double") / float(1 << 53)
    found = of.filter(draw < share).select(name).limit(most).toArrow()
    if not found.num_rows:
        found = of.select(name).limit(most).toArrow()
    return matrix(found.column(0).combine_chunks(), dim)
