"""Bounds that split a key space, and the predicates that read the parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scratch import keep


def ntile_bounds(df: DataFrame, key: str, parts: int) -> DataFrame:
    """partition_id, min_key, max_key and row_count of ``parts`` equally filled parts in key order.

    Exact and distributed. Rows are range-partitioned by key and sorted in place; the size of each
    partition, one row for each, gives every row its place in the whole order, and the place its part as
    ntile() defines it. Only per-partition totals meet in one task.
    """
    keys = df.select(key).repartitionByRange(F.col(key).asc_nulls_last()).sortWithinPartitions(F.asc_nulls_last(key))
    keys = keys.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    # Written once: two runs of a range partitioning may sample different bounds.
    local = keep(keys.withColumn("_at", F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33)), "ntile-keys")
    sizes = local.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_total"))
    placed = local.join(heads, "_part").withColumn("_place", F.col("_before") + F.col("_at"))
    small, extra = F.expr(f"_total div {parts}"), F.expr(f"_total % {parts}")
    large = extra * (small + 1)
    bucket = F.when(F.col("_place") < large, F.floor(F.col("_place") / (small + 1))).otherwise(extra + F.floor((F.col("_place") - large) / F.greatest(small, F.lit(1))))
    return (
        placed.withColumn("partition_id", (bucket + 1).cast("int"))
        .groupBy("partition_id")
        .agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count("*").alias("row_count"))
    )


def ntile_bounds_single(df: DataFrame, key: str, parts: int) -> DataFrame:
    """The same by ntile() over one window: one task sorts all keys, for small tables."""
    placed = df.select(key, F.ntile(parts).over(Window.orderBy(F.asc_nulls_last(key))).alias("partition_id"))
    return placed.groupBy("partition_id").agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count("*").alias("row_count"))


def equal_width(low: int | None, high: int | None, parts: int) -> list[tuple[int, int]]:
    """Half-open ranges [a, b) of nearly equal width that cover [low, high] once, at most ``parts``."""
    if low is None or high is None:
        return []
    parts = max(1, min(parts, high - low + 1))
    width, extra = divmod(high - low + 1, parts)
    out, at = [], low
    for i in range(parts):
        step = width + (i < extra)
        out.append((at, at + step))
        at += step
    return out


def equal_width_ranges(df: DataFrame, key: str, parts: int) -> DataFrame:
    """partition_id, range_start, range_end: the ranges of the key's own minimum and maximum."""
    bounds = df.agg(F.min(key).cast("long").alias("lo"), F.max(key).cast("long").alias("hi")).filter("lo is not null")
    bounds = bounds.withColumn("n", F.least(F.lit(parts).cast("long"), F.expr("hi - lo + 1")))
    each = bounds.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    start = "lo + i * ((hi - lo + 1) div n) + least(i, (hi - lo + 1) % n)"
    end = start.replace("i *", "(i + 1) *").replace("least(i,", "least(i + 1,")
    return each.select((F.col("i") + 1).cast("int").alias("partition_id"), F.expr(start).alias("range_start"), F.expr(end).alias("range_end"))


def range_row_counts(df: DataFrame, key: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """Rows in each half-open range, empty ones too: one pass over the rows; without ranges no row."""
    spark = df.sparkSession
    if not ranges:
        return spark.createDataFrame([], "partition_id int, row_count long")
    low, width, extra = ranges[0][0], ranges[-1][1] - ranges[-1][0], sum(b - a > ranges[-1][1] - ranges[-1][0] for a, b in ranges)
    at = F.col(key) - low
    cut = extra * (width + 1)
    number = F.when(at < cut, F.floor(at / (width + 1))).otherwise(extra + F.floor((at - cut) / width))
    counted = df.filter(F.col(key).between(ranges[0][0], ranges[-1][1] - 1)).groupBy((number + 1).cast("int").alias("partition_id")).agg(F.count("*").alias("row_count"))
    every = spark.range(1, len(ranges) + 1).select(F.col("id").cast("int").alias("partition_id"))
    return every.join(counted, "partition_id", "left").select("partition_id", F.coalesce("row_count", F.lit(0)).cast("long").alias("row_count"))


def predicates(key: str, ranges: list[tuple[int, int]]) -> list[str]:
    """One SQL condition for each range, open at both ends, nulls with the first: no row is read twice or lost."""
    if len(ranges) < 2:
        return ["1 = 1"]
    out = []
    for i, (a, b) in enumerate(ranges):
        parts = [f"{key} >= {a}"] * (i > 0) + [f"{key} < {b}"] * (i < len(ranges) - 1)
        text = " AND ".join(parts)
        out.append(f"({text} OR {key} IS NULL)" if i == 0 else text)
    return out


def partition_count(rows: int, least: int, readers: int, threshold: int) -> int:
    """How many parts a table of so many rows is read in."""
    return max(1, min(readers, -(-rows // least))) if rows >= threshold else 1
