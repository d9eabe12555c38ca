"""Comparing source and target: counts, then buckets, then row hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name and row_count; counts of parquet come from file footers."""
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def reconcile(source: DataFrame, target: DataFrame) -> DataFrame:
    """Counts side by side; a table that one side lacks has null there and does not match."""
    s = source.select("table_name", F.col("row_count").alias("source_count"))
    t = target.select("table_name", F.col("row_count").alias("target_count"))
    return s.join(t, "table_name", "full_outer").withColumn("is_match", F.coalesce(F.col("source_count") == F.col("target_count"), F.lit(False)))


def row_hash(columns: list[str]) -> Column:
    """md5 of the values as text; nulls are marked, so that they differ from empty text and keep their place.

    A bar or backslash in a value is escaped: no value can look like the end of one and the start of another.
    """

    def text(name: str) -> Column:
        value = F.replace(F.replace(F.col(name).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
        return F.coalesce(F.concat(F.lit("v"), value), F.lit("n"))

    return F.md5(F.concat_ws("|", *[text(c) for c in columns]))


def bucket_diff(source: DataFrame, target: DataFrame, key: str, width: int) -> DataFrame:
    """Key buckets whose counts differ."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.expr(f"cast(floor({key} / {width}) as bigint)").alias("bucket")).agg(F.count("*").alias(name))

    both = counted(source, "source_count").join(counted(target, "target_count"), "bucket", "full_outer").na.fill(0)
    return both.filter("source_count <> target_count")


def hash_diff(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys whose rows are missing, extra or different."""
    s = source.select(*keys, row_hash(columns).alias("_s"))
    t = target.select(*keys, row_hash(columns).alias("_t"))
    status = F.when(F.col("_t").isNull(), "missing").when(F.col("_s").isNull(), "extra").otherwise("different")
    return s.join(t, keys, "full_outer").filter(~F.col("_s").eqNullSafe(F.col("_t"))).select(*keys, status.alias("status"))


def tiered(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str], width: int = 10_000) -> DataFrame:
    """Hash comparison of the rows in buckets whose fingerprints differ, by one numeric key.

    A bucket's fingerprint sums row hashes, so an update shows although counts agree; only the rows of
    differing buckets are joined.
    """
    key = keys[0]
    bucket = F.expr(f"cast(floor({key} / {width}) as bigint)")

    def prints(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(bucket.alias("_bucket")).agg(F.struct(F.count("*"), F.sum(F.xxhash64(row_hash(columns)).cast("decimal(38,0)"))).alias(name))

    differ = prints(source, "a").join(prints(target, "b"), "_bucket", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("_bucket")
    narrow = [df.withColumn("_bucket", bucket).join(differ, "_bucket", "left_semi").drop("_bucket") for df in (source, target)]
    return hash_diff(*narrow, keys, columns)


def empty_counts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "table_name string, row_count long")
