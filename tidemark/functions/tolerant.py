"""Conversion that goes on where a value does not fit: good rows, rejects with what was wrong, and counts, of one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

_REJECTS = "_rejects"


class TooManyRejects(ValueError):
    """More rows were rejected than the limit allows."""


def converted(df: DataFrame, types: dict[str, str], nulls: bool = False) -> DataFrame:
    """``df`` with the columns in their types, and ``_rejects``: column and value of each that is not null and does not fit.

    With ``nulls`` a value that does not fit is a null and rejects nothing, but is told all the same.
    """
    bad: list[Column] = []
    for name, kind in types.items():
        fits = F.col(name).try_cast(kind)
        bad.append(F.when(F.col(name).isNotNull() & fits.isNull(), F.struct(F.lit(name).alias("column_name"), F.col(name).cast("string").alias("value"))))
    found = F.filter(F.array(*bad), lambda x: x.isNotNull()) if bad else F.array().cast("array<struct<column_name:string,value:string>>")
    columns = [F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns]
    return df.select(*columns, found.alias(_REJECTS)).withColumn("_good", F.lit(True) if nulls else F.size(_REJECTS) == 0)


class Conversion:
    """The parts of one pass over ``df``: ``good`` rows, ``rejects`` (key, column_name, value) and ``counts()``."""

    def __init__(self, df: DataFrame, types: dict[str, str], keys: list[str], limit: int | None = None, nulls: bool = False):
        from tidemark.scratch import keep

        seen = Observation()
        rows = converted(df, types, nulls)
        by = [F.sum(F.array_contains(F.col(f"{_REJECTS}.column_name"), c).cast("long")).alias(c) for c in types]
        rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum((~F.col("_good")).cast("long")).alias("rejected"), *by)
        # Written once: both sides and the counts come from one read of the source.
        self.kept = keep(rows, "converted")
        try:
            found = seen.get
        except Exception:  # the planner saw that there is nothing to read, and dropped the counters
            found = dict.fromkeys(["rows", "rejected", *types], 0)
        self._counts = {k: int(v or 0) for k, v in found.items()}
        if limit is not None and self._counts["rejected"] > limit:
            self.close()
            worst = max(types, key=lambda c: self._counts[c])
            raise TooManyRejects(f"{self._counts['rejected']} rows do not fit, {limit} may; most by {worst}")
        self.good = self.kept.filter("_good").select(*df.columns)
        self.rejects = self.kept.filter(F.size(_REJECTS) > 0).select(*keys, F.explode(_REJECTS).alias("x")).select(*keys, "x.column_name", "x.value")

    def counts(self) -> dict[str, int]:
        """rows, rejected, and for each column the values that did not fit."""
        return dict(self._counts)

    def close(self) -> None:
        from tidemark.scratch import drop

        drop(self.kept)


