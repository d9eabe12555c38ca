"""Constraints as queries: what a target database would have refused."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.idents import spark_check
from tidemark.model import TableMeta


def pk_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).filter("row_count > 1")


def fk_orphans(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Child rows whose reference, if complete, names no parent."""
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    keys = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(parent_columns)])
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(columns)])
    return child.filter(ok).join(keys, on, "left_anti")


def null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name and null_count of each column that must not be null: one pass over the table."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("column_name", "null_count"))


def check_violations(df: DataFrame, definition: str) -> DataFrame:
    """Rows for which a check is false; unknown passes, as in a database."""
    return df.filter(~F.coalesce(F.expr(spark_check(definition)), F.lit(True)))


def next_sequence(df: DataFrame, key: str, sink: str = "mysql") -> DataFrame:
    """Value a sequence is set to: the next one, or, for PostgreSQL's setval, the last used (1 if none)."""
    top = F.coalesce(F.max(key), F.lit(0)).cast("long")
    return df.agg((F.greatest(top, F.lit(1).cast("long")) if sink == "postgres" else top + 1).alias("next_value"))


def fk_levels(tables: list[TableMeta]) -> list[list[str]]:
    """Tables in levels, parents first. References to itself or outside the set do not count; a cycle ends as one level."""
    names = [t.name for t in tables]
    needs = {t.name: {f.parent for f in t.foreign_keys if f.parent in names and f.parent != t.name} for t in tables}
    levels: list[list[str]] = []
    while needs:
        free = sorted(n for n, parents in needs.items() if not parents & needs.keys())
        level = free or sorted(needs)
        levels.append(level)
        for n in level:
            del needs[n]
    return levels
