"""Before a copy: which values would the target's column types refuse? One pass over a table, one row for each column.

A value is refused if its text is longer than the type takes (characters; UTF-16 units in SQL Server; bytes in the small texts
of MySQL), if its number, date or size lies outside the type's range, if it is NaN or infinite where there is no such number, if it
holds a NUL character for PostgreSQL, if it is no uuid or no JSON where one is due, or if it is null and must not be.
Rounding to fewer decimals refuses nothing. Repeated rows count as often as they occur; an empty table has columns with zeros.
"""

from __future__ import annotations

import decimal
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.convert import utf16_bytes
from tidemark.functions.types import dialect, map_type
from tidemark.model import ColumnMeta

# Ranges of whole numbers, bytes of texts and blobs in MySQL, and first years of dates.
_RANGES = {"smallint": (-(1 << 15), (1 << 15) - 1), "int": (-(1 << 31), (1 << 31) - 1), "integer": (-(1 << 31), (1 << 31) - 1), "bigint": (-(1 << 63), (1 << 63) - 1), "tinyint unsigned": (0, 255)}
_MSSQL_TINYINT = (0, 255)
_MYSQL_BYTES = {"tinytext": 255, "text": 65_535, "mediumtext": 16_777_215, "tinyblob": 255, "blob": 65_535, "mediumblob": 16_777_215}
_FIRST_YEAR = {("mssql", "datetime"): 1753, ("mssql", "smalldatetime"): 1900, ("mssql", "datetime2"): 1, ("mssql", "datetimeoffset"): 1, ("mssql", "date"): 1, ("mysql", "datetime"): 1000, ("mysql", "date"): 1000}
_LAST_YEAR = {("mssql", "smalldatetime"): 2078}
_UUID = r"^\{?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\}?$"

_SHAPE = re.compile(r"([a-z0-9 ]+?)(?:\((\d+|max)(?:,(\d+))?\))?( varying| unsigned| auto_increment)?")
_SIZED_TEXT = {"char", "nchar", "varchar", "nvarchar"}


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


# Most digits of a whole number.
_DIGITS = {"byte": 3, "short": 5, "integer": 10, "long": 19}


def _too_many_digits(c: Column, kind: T.DataType, digits: int, scale: int) -> Column | None:
    """Whether a number, rounded to ``scale``, has more than ``digits`` digits. A try_cast tells the same, but throws for each that has."""
    whole = digits - scale
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.round(F.abs(c), scale) >= F.lit(10.0**whole)
    own, decimals = (kind.precision - kind.scale, kind.scale) if isinstance(kind, T.DecimalType) else (_DIGITS[kind.typeName()], 0)
    if own < whole or (own == whole and decimals <= scale):
        return None
    limit, value = F.lit(decimal.Decimal(10) ** whole), F.round(c, scale) if decimals > scale else c
    return (value >= limit) | (value <= -limit)


def refusal(c: Column, kind: T.DataType, sink: str, target: str) -> Column | None:
    """Whether a value that is not null is refused by a column of this type; None where the type takes every value."""
    found = _SHAPE.fullmatch(target.lower())
    if not found:
        return None
    name = found[1] + (found[4] if found[4] == " unsigned" else "")
    size = int(found[2]) if found[2] and found[2] != "max" else None
    tests: list[Column] = []
    if isinstance(kind, T.StringType):
        if size is not None and name in _SIZED_TEXT:
            tests.append((utf16_bytes(c) > 2 * size) if sink == "mssql" else (F.char_length(c) > size))
        if sink == "mysql" and name in _MYSQL_BYTES:
            tests.append(F.octet_length(c) > _MYSQL_BYTES[name])
        if sink == "postgres" and name in {"text", "json", "jsonb", *_SIZED_TEXT}:
            tests.append(F.instr(c, F.lit("\0")) > 0)
        if name in ("uuid", "uniqueidentifier"):
            tests.append(~c.rlike(_UUID))
        if name in ("json", "jsonb"):
            tests.append(c.isNotNull() & F.try_parse_json(c).isNull())
    elif isinstance(kind, T.BinaryType):
        most = size if name in ("binary", "varbinary") else _MYSQL_BYTES.get(name) if sink == "mysql" else None
        if most is not None:
            tests.append(F.octet_length(c) > most)
    elif isinstance(kind, T.NumericType):
        if isinstance(kind, (T.FloatType, T.DoubleType)) and (sink in ("mssql", "mysql") or name in _RANGES):
            tests.append(F.isnan(c) | (F.abs(c) == float("inf")))
        bounds = _MSSQL_TINYINT if (sink, name) == ("mssql", "tinyint") else _RANGES.get(name)
        if bounds:
            tests.append((c < F.lit(bounds[0])) | (c > F.lit(bounds[1])))
        if name in ("decimal", "numeric") and size is not None and (digits := _too_many_digits(c, kind, size, int(found[3] or 0))) is not None:
            tests.append(digits)
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) and (first := _FIRST_YEAR.get((sink, name))):
        tests.append((F.year(c) < first) | (F.year(c) > _LAST_YEAR.get((sink, name), 9999)))
    return reduce(lambda a, b: a | b, tests) if tests else None


def _checked(df: DataFrame, columns: tuple[ColumnMeta, ...], source: str, sink: str, profile: str) -> list[tuple]:
    """Of each column of ``df`` that is described: name, mapping and whether its value is refused (never null)."""
    out = []
    fields = {f.name.lower(): f for f in df.schema.fields}
    for c in columns:
        if (f := fields.get(c.name.lower())) is None:
            continue
        to = map_type(source, sink, c.native, c.length, c.precision, c.scale, profile)
        value = _named(f.name)
        test = refusal(value, f.dataType, sink, to.target)
        bad = F.coalesce(test, F.lit(False)) if test is not None else F.lit(False)
        out.append((f.name, to, value, bad if c.nullable else bad | value.isNull()))
    return out


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "column_name string, target_type string, is_lossy boolean, n_rows long, n_nulls long, n_refused long")


def fit(df: DataFrame, columns: tuple[ColumnMeta, ...], source: str, sink: str, profile: str = "direct") -> DataFrame:
    """column_name, target_type, is_lossy, n_rows, n_nulls and n_refused of each described column: one aggregate, combined in each task."""
    checked = _checked(df, columns, source, dialect(sink), profile)
    if not checked:
        return nothing(df.sparkSession)
    counts = [x for i, (_, _, value, bad) in enumerate(checked) for x in (F.count_if(value.isNull()).alias(f"null_{i}"), F.count_if(bad).alias(f"bad_{i}"))]
    whole = df.agg(F.count(F.lit(1)).alias("n"), *counts)
    rows = [
        F.struct(F.lit(name).alias("column_name"), F.lit(to.target).alias("target_type"), F.lit(to.lossy).alias("is_lossy"), F.col("n").alias("n_rows"), F.col(f"null_{i}").alias("n_nulls"), F.col(f"bad_{i}").alias("n_refused"))
        for i, (name, to, _, _) in enumerate(checked)
    ]
    return whole.select(F.inline(F.array(*rows)))


def refused_rows(df: DataFrame, columns: tuple[ColumnMeta, ...], source: str, sink: str, profile: str = "direct", name: str = "refused_columns") -> DataFrame:
    """The rows of which at least one value is refused, with the names of those columns in order."""
    checked = _checked(df, columns, source, dialect(sink), profile)
    if not checked:
        return df.withColumn(name, F.array().cast("array<string>")).limit(0)
    told = F.array_compact(F.array(*[F.when(bad, F.lit(column)) for column, _, _, bad in checked]))
    return df.select("*", told.alias(name)).filter(F.size(_named(name)) > 0)
