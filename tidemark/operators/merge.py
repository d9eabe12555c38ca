"""Merging a source into a target by key: insert and update, never delete.

The merge is one full outer join on the key, so both sides are shuffled once by the key, or not at all
where they are bucketed by it. The source wins whenever it has the key, nulls included: presence is
a flag, never a coalesce of values. Small sources are broadcast by the planner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import latest_by

ACTIONS = ("insert", "update", "noop", "keep")


class NoPrimaryKey(ValueError):
    """Upsert needs a key."""


def _need(keys: list[str]) -> None:
    if not keys:
        raise NoPrimaryKey("a merge needs a primary key")


def dedupe_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    _need(keys)
    return latest_by(df, keys, order)


def insert_missing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The target and the source rows whose key it lacks: all a table of nothing but keys can take."""
    _need(keys)
    new = source.join(target.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return target.unionByName(new.select(*target.columns))


def classify(target: DataFrame, source: DataFrame, keys: list[str], compare: list[str] | None = None) -> DataFrame:
    """The merged rows with ``action``: insert, update, noop (equal, nulls and NaN included) or keep.

    Both sides must have one row for each key.
    """
    _need(keys)
    columns = target.columns
    rest = [c for c in columns if c not in keys]
    compare = rest if compare is None else compare
    t = target.select(*keys, F.struct(*[F.col(c) for c in rest], F.lit(True).alias("_here")).alias("_t"))
    s = source.select(*keys, F.struct(*[F.col(c) for c in rest], F.lit(True).alias("_here")).alias("_s"))
    both = t.join(s, keys, "full_outer")
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"_t.{c}").eqNullSafe(F.col(f"_s.{c}"))
    there, here = F.col("_t._here").isNotNull(), F.col("_s._here").isNotNull()
    action = F.when(~here, "keep").when(~there, "insert").when(same, "noop").otherwise("update")
    values = [F.col(c) if c in keys else F.when(here, F.col(f"_s.{c}")).otherwise(F.col(f"_t.{c}")).alias(c) for c in columns]
    return both.select(*values, action.alias("action"))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """The target after the merge. With ``order`` the source may hold a key more than once; the first wins."""
    _need(keys)
    if order is not None:
        source = dedupe_latest(source, keys, order)
    if set(target.columns) == set(keys):
        return insert_missing(target, source, keys)
    return classify(target, source, keys, []).drop("action").select(*target.columns)


def changed_rows(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Only what has to be written: inserts and real updates."""
    return classify(target, source, keys).filter(F.col("action").isin("insert", "update"))
