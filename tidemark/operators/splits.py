"""Parts of a table between cut points of its key, whatever the key's types and however its values lie.

A cut point is a tuple of key values. ``cut_points`` takes them where equally many rows lie between, so skewed keys
make parts of equal size; the rows that are counted are the table's, or a sample that gives each part ``PER_PART`` of them. A part
holds the rows after one cut point and up to the next. Nulls come before all values. The test for "after" is never unknown, so every
row lies in one part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.idents import literal, quote
from tidemark.operators.partition import ntile_bounds

#: Sampled rows of a part: its size is then off by some 3 %.
PER_PART = 1000

Cut = Sequence  # one value, as text or null, for each key column


def cut_points(df: DataFrame, keys: list[str], parts: int, rows: int | None = None, exact: bool = False) -> list[list[str | None]]:
    """At most ``parts`` - 1 cut points of ``df`` in key order, each value as text; of all rows if ``exact``."""
    if parts < 2:
        return []
    rows = df.count() if rows is None else rows
    share = PER_PART * parts / max(rows, 1)
    some = df.select(*keys) if exact or share >= 0.5 else df.select(*keys).sample(share, 20240501)
    bounds = ntile_bounds(some.select(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("key")), "key", parts)
    texts = [F.col(f"max_key.k{i}").cast("string").alias(f"k{i}") for i in range(len(keys))]
    found = [list(r)[1:] for r in bounds.select("partition_id", *texts).orderBy("partition_id").collect()]
    out: list[list[str | None]] = []
    for cut in found[:-1]:
        if cut != (out[-1] if out else found[-1]) and cut != found[-1]:
            out.append(cut)
    return out


def after(df: DataFrame, keys: list[str], cut: Cut) -> Column:
    """Whether a row's key comes after the cut point: true or false, nulls first."""
    out = F.lit(False)
    for k, text in reversed(list(zip(keys, cut, strict=True))):
        c, value = F.col(k), F.lit(text).cast(df.schema[k].dataType)
        more = c.isNotNull() if text is None else F.coalesce(c > value, F.lit(False))
        out = more | (c.eqNullSafe(value) & out)
    return out


def between(df: DataFrame, keys: list[str], low: Cut | None, high: Cut | None) -> DataFrame:
    """Rows after ``low`` and up to ``high``, as far as given; the first key column's bounds reach the scan."""
    first = keys[0]
    if low is not None:
        if low[0] is not None:
            df = df.filter(F.col(first) >= F.lit(low[0]).cast(df.schema[first].dataType))
        df = df.filter(after(df, keys, low))
    if high is not None:
        if high[0] is not None:
            df = df.filter(F.col(first).isNull() | (F.col(first) <= F.lit(high[0]).cast(df.schema[first].dataType)))
        df = df.filter(~after(df, keys, high))
    return df


def part_numbers(df: DataFrame, keys: list[str], cuts: list[Cut], name: str = "part") -> DataFrame:
    """``df`` with the number of each row's part, from 1."""
    return df.withColumn(name, sum((after(df, keys, cut).cast("int") for cut in cuts), F.lit(1)))


def _value(dialect: str, text: str | None, number: bool) -> str:
    if text is None:
        return "NULL"
    if number:
        return str(float(text)) if "." in text or "e" in text.lower() else str(int(text))
    return literal(text.replace("\\", "\\\\") if dialect == "mysql" else text)


def sql_between(dialect: str, keys: list[str], low: Cut | None, high: Cut | None, numbers: set[str] = frozenset()) -> str:
    """The same as SQL of a database whose keys are not null; comparisons are spelled out, as not all know row values."""

    def test(cut: Cut, strict: str, last: str) -> str:
        out = ""
        for k, text in reversed(list(zip(keys, cut, strict=True))):
            c, v = quote(dialect, k), _value(dialect, text, k in numbers)
            out = f"{c} {last} {v}" if not out else f"({c} {strict} {v} OR ({c} = {v} AND {out}))"
        return out

    parts = [test(low, ">", ">")] if low is not None else []
    parts += [test(high, "<", "<=")] if high is not None else []
    text = " AND ".join(parts) or "1 = 1"
    return f"({text} OR {quote(dialect, keys[0])} IS NULL)" if low is None and high is not None else text
