"""Scans: key ranges, pages, slices and the watermark filter.

A bulk read is one scan with a range predicate that reaches the source; no loop of pages runs on the
driver. Pages exist for callers that want one.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class WatermarkError(ValueError):
    """The mark lies in the future or too far back to be one."""


def key_range(df: DataFrame, key: str, lower=None, upper=None, after=None) -> DataFrame:
    """Rows with lower <= key, after < key and key <= upper, as far as given."""
    for bound, test in ((lower, lambda c, b: c >= b), (after, lambda c, b: c > b), (upper, lambda c, b: c <= b)):
        if bound is not None:
            df = df.filter(test(F.col(key), F.lit(bound)))
    return df


def keyset_page(df: DataFrame, key: str, limit: int, after=None, start=None, upper=None) -> DataFrame:
    """The next ``limit`` rows in key order; the first page may start at a key, later ones follow the last."""
    return key_range(df, key, lower=start, upper=upper, after=after).orderBy(F.asc_nulls_last(key)).limit(limit)


def offset_page(df: DataFrame, keys: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page by position, for composite, text or absent keys (then the first column orders)."""
    order = keys or df.columns[:1]
    return df.orderBy(*[F.asc_nulls_last(k) for k in order]).offset(offset).limit(limit)


def row_slice(df: DataFrame, keys: list[str], first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last`` in key order, counted from 1, with row_num.

    Only the first ``last`` rows in order are numbered: they come from a distributed top-k, so the one task
    that numbers them never holds the table.
    """
    head = df.orderBy(*[F.asc_nulls_last(k) for k in keys]).limit(last)
    numbered = head.withColumn("row_num", F.row_number().over(Window.orderBy(*[F.asc_nulls_last(k) for k in keys])))
    return numbered.filter(F.col("row_num").between(first, last))


def since(column: str, mark: dt.datetime, overlap: dt.timedelta = dt.timedelta(0), zoned: bool = False) -> Column:
    """Rows newer than the mark (UTC), or never stamped; the mark counts in milliseconds and is excluded.

    A ``zoned`` column holds instants: it is compared with an instant, whatever the session's time zone.
    """
    at = mark - overlap
    at = at.replace(microsecond=at.microsecond // 1000 * 1000)
    if zoned:
        micros = (at - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        bound = F.timestamp_micros(F.lit(micros).cast("long"))
    else:
        bound = F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")
    return (F.col(column) > bound) | F.col(column).isNull()


def watermark_filter(df: DataFrame, column: str, mark: dt.datetime | None, now: dt.datetime | None = None, overlap: dt.timedelta = dt.timedelta(0)) -> DataFrame:
    """The incremental part of a table; everything if there is no mark or it is not credible."""
    if mark is None:
        return df
    try:
        check_watermark(mark, now)
    except WatermarkError:
        return df
    return df.filter(since(column, mark, overlap, isinstance(df.schema[column].dataType, T.TimestampType)))


def check_watermark(mark: dt.datetime, now: dt.datetime | None = None) -> None:
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    if mark > now + dt.timedelta(hours=1):
        raise WatermarkError(f"{mark} is more than an hour ahead")
    if mark < now - dt.timedelta(days=36_500):
        raise WatermarkError(f"{mark} is more than 36500 days old")


def pick_watermark_column(df: DataFrame, candidates: list[str]) -> tuple[str, bool] | None:
    """First candidate, in order, that names a date or time column whatever the case; and whether it knows its zone."""
    kinds = {f.name.lower(): (f.name, f.dataType.simpleString()) for f in df.schema.fields}
    for name in candidates:
        found = kinds.get(name.lower())
        if found and found[1] in ("date", "timestamp", "timestamp_ntz"):
            return found[0], found[1] == "timestamp"
    return None


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in ``order``; the filter on the rank is pushed below the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def marks(tables: dict[str, DataFrame], candidates: list[str]) -> DataFrame:
    """table_name, column_name, mark and n_nulls of each table that has one of the columns: the greatest value, and the rows without."""
    found = [(name, df, picked[0]) for name, df in tables.items() if (picked := pick_watermark_column(df, candidates))]
    parts = [df.agg(F.max(c).cast("timestamp_ntz").alias("mark"), F.count_if(F.col(c).isNull()).alias("n_nulls")).select(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), "mark", "n_nulls") for name, df, c in found]
    if not parts:
        return next(iter(tables.values())).sparkSession.createDataFrame([], "table_name string, column_name string, mark timestamp_ntz, n_nulls long")
    return reduce(DataFrame.unionByName, parts)


def ordered_texts(df: DataFrame, by: list[str], column: str, order: list[str], name: str, mark: str = ",") -> DataFrame:
    """The texts of a group in order, joined; nulls are left out. A group must be small by nature: its text is one value."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in (column, *order)]
    joined = F.expr(f"listagg(CAST({quoted[0]} AS STRING), '{mark}') WITHIN GROUP (ORDER BY {', '.join(quoted[1:])})")
    return df.groupBy(*by).agg(joined.alias(name))
