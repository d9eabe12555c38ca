"""Pieces that several operators share: text keys, and complete groups out of sorted batches."""

from __future__ import annotations

import contextlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.text import mix


def with_keys(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with k1, k2: 128 bits that name the text; a null counts as an empty text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn("k1", F.xxhash64(whole)).withColumn("k2", F.xxhash64(F.lit(0x7465), whole))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)


def scatter(*parts: np.ndarray) -> np.ndarray:
    """A hash of integer arrays, for rows that may go anywhere."""
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + p.astype(np.int64).view(np.uint64))
    return h


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows that hold complete groups, from batches sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        changes = np.flatnonzero(values[1:] != values[:-1]) + 1
        if held:
            last = held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py()
            if values[0] != last:
                changes = np.append(0, changes)
        if len(changes) and count + changes[-1] >= rows:
            cut = int(changes[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, count = [batch.slice(cut)], batch.num_rows - cut
        else:
            held.append(batch)
            count += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2_000):
    """Jobs that run in this block hand whole texts to Python in smaller batches: each lies in the JVM and in Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def grouped(df: DataFrame, key: str) -> DataFrame:
    """All rows of a key in one partition, in order of the key."""
    return df.repartition(key).sortWithinPartitions(key)

