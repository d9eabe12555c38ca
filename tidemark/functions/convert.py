"""Value conversions on the way to a sink, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of UTF-16 text that bulk insertion into SQL Server takes in one value.
MOST_UTF16 = 65_535


def utf16_bytes(c: Column) -> Column:
    """Two bytes for each character and two more for each outside the basic plane (four bytes in UTF-8)."""
    return F.octet_length(F.encode(c, "UTF-16LE")).cast("long")


def oversized(df: DataFrame, most: int = MOST_UTF16) -> Column:
    """Whether any text of the row is too long for bulk insertion."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    out = F.lit(False)
    for name in texts:
        out = out | F.coalesce(utf16_bytes(F.col(name)) > most, F.lit(False))
    return out


def route_oversized(df: DataFrame, most: int = MOST_UTF16) -> tuple[DataFrame, DataFrame]:
    """Rows for bulk insertion and rows for plain inserts."""
    test = oversized(df, most)
    return df.filter(~test), df.filter(test)


def _escaped(c: Column, steps: list[tuple[str, str]]) -> Column:
    for old, new in steps:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape_tsv(c: Column) -> Column:
    r"""For LOAD DATA: backslash, tab, newline, carriage return and NUL escaped; null is \N."""
    return F.coalesce(_escaped(c, [("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0")]), F.lit("\\N"))


def escape_copy(c: Column) -> Column:
    r"""For text COPY: backslash, tab, newline and carriage return escaped, NUL dropped; null is \N."""
    return F.coalesce(_escaped(c, [("\0", ""), ("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")]), F.lit("\\N"))


def copy_text(c: Column, kind: T.DataType) -> Column:
    """A value as text COPY wants it."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(F.when(c, "t").when(~c, "f"), F.lit("\\N"))
    if isinstance(kind, T.BinaryType):
        return F.coalesce(F.concat(F.lit("\\\\x"), F.lower(F.hex(c))), F.lit("\\N"))
    return escape_copy(c.cast("string"))


def days_since_2000(c: Column) -> Column:
    return F.datediff(c.cast("date"), F.lit("2000-01-01").cast("date"))


def micros_since_2000(c: Column) -> Column:
    """Microseconds of a timestamp without zone since 2000-01-01."""
    return F.unix_micros(c.cast("timestamp")) - F.lit(946_684_800_000_000)


def ticks(c: Column) -> Column:
    """Units of 100 ns since the start of year 1, as SQL Server counts."""
    return (F.unix_micros(c.cast("timestamp")) + F.lit(62_135_596_800_000_000)).cast("decimal(20,0)") * 10


def midnight(c: Column) -> Column:
    return c.cast("date").cast("timestamp_ntz")


def utc_naive(c: Column) -> Column:
    """An instant as its UTC clock time without zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))


def millis_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def bit_bytes(bits: Column) -> Column:
    return F.ceil(bits / 8).cast("int")


def hex_text(c: Column) -> Column:
    return F.lower(F.hex(c))


def base10000(c: Column) -> Column:
    """Digits of a non-negative whole decimal in groups of four, most significant first."""
    text = F.regexp_replace(c.cast("decimal(38,0)").cast("string"), "^0+", "")
    width = F.ceil(F.length(text) / 4).cast("int") * 4
    padded = F.lpad(text, width, "0")
    groups = F.transform(F.sequence(F.lit(1), F.greatest(width, F.lit(4)), F.lit(4)), lambda i: padded.substr(i, F.lit(4)).cast("int"))
    return F.when(F.length(text) == 0, F.array().cast("array<int>")).otherwise(groups)


def decimal_text(digits: Column, weight: Column, negative: Column, scale: Column) -> Column:
    """The number of base-10000 ``digits``, the first worth 10000 ** weight, with ``scale`` decimals, as text."""

    def group(i: Column) -> Column:
        return F.lpad(F.coalesce(F.get(digits, i), F.lit(0)).cast("string"), F.lit(4), F.lit("0"))

    def groups(low: Column, high: Column) -> Column:
        some = F.transform(F.sequence(low, high), group)
        return F.when(low <= high, F.array_join(some, "")).otherwise("")

    whole = F.regexp_replace(groups(F.least(F.lit(0), weight), weight), "^0+(?=.)", "")
    whole = F.when(whole == "", "0").otherwise(whole)
    # Digits before the first one are zero where the number is under one.
    first = F.least(weight + 1, F.lit(0))
    lead = F.repeat(F.lit("0000"), F.greatest(-weight - 1, F.lit(0)))
    last = F.greatest(F.size(digits) - 1, weight + 1 + F.ceil(scale / 4).cast("int"))
    tail = F.concat(lead, groups(F.greatest(weight + 1, F.lit(0)), last))
    fraction = F.rpad(F.substring(tail, F.lit(1), scale), scale, F.lit("0"))
    text = F.when(scale > 0, F.concat(whole, F.lit("."), fraction)).otherwise(whole)
    text = F.when(negative & F.regexp_like(text, F.lit("[1-9]")), F.concat(F.lit("-"), text)).otherwise(text)
    return F.when(digits.isNotNull(), text)


def signed_base10000(c: Column, scale: int) -> Column:
    """A decimal as (negative, scale, digits, weight): groups of four digits around the point, most significant first."""
    plain = F.abs(c.cast(f"decimal(38,{scale})"))
    parts = F.split(plain.cast("string"), r"\.")
    whole = F.when(parts[0] == "0", "").otherwise(parts[0])
    width = F.ceil(F.length(whole) / 4).cast("int") * 4
    after = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    text = F.concat(F.lpad(whole, width, F.lit("0")), F.rpad(after, F.ceil(F.length(after) / 4).cast("int") * 4, F.lit("0")))
    count = (F.length(text) / 4).cast("int")
    groups = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * 4 + 1, F.lit(4)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(c.isNotNull(), F.struct((c < 0).alias("negative"), F.lit(scale).alias("scale"), groups.alias("digits"), ((width / 4).cast("int") - 1).alias("weight")))


def uuid_text(c: Column) -> Column:
    """Sixteen bytes as a uuid in lower case."""
    h = hex_text(c)
    return F.when(F.octet_length(c) == 16, F.concat_ws("-", *[h.substr(a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def uuid_bytes(c: Column) -> Column:
    return F.unhex(F.replace(c, F.lit("-"), F.lit("")))


def packed_texts(df: DataFrame, column: str, least: int = 64) -> DataFrame:
    """``df`` with the text of ``column`` as four bytes of its size in UTF-8 and its bytes: an LZ4 block if it has ``least`` bytes or
    more and the block is smaller, else as they are. So a text whose bytes are as many as its size says is not packed. Null stays null."""
    import pyarrow as pa

    at = df.schema.fieldNames().index(column)
    kind = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == column else f for f in df.schema.fields])

    def work(batches):
        codec = pa.Codec("lz4_raw")

        def body(v: bytes) -> bytes:
            return min(v, codec.compress(v, asbytes=True), key=len) if len(v) >= least else v

        for batch in batches:
            raw = [None if v is None else v.encode() for v in batch.column(at).to_pylist()]
            out = [None if v is None else len(v).to_bytes(4, "little") + body(v) for v in raw]
            yield batch.set_column(at, column, pa.array(out, pa.binary()))

    return df.mapInArrow(work, kind)


def unpacked_texts(df: DataFrame, column: str) -> DataFrame:
    """What ``packed_texts`` was given."""
    import pyarrow as pa

    at = df.schema.fieldNames().index(column)
    kind = T.StructType([T.StructField(f.name, T.StringType()) if f.name == column else f for f in df.schema.fields])

    def work(batches):
        codec = pa.Codec("lz4_raw")

        def body(size: int, v: bytes) -> bytes:
            return v if len(v) == size else codec.decompress(v, size, asbytes=True)

        for batch in batches:
            out = [None if v is None else body(int.from_bytes(v[:4], "little"), v[4:]).decode() for v in batch.column(at).to_pylist()]
            yield batch.set_column(at, column, pa.array(out, pa.string()))

    return df.mapInArrow(work, kind)


def sink_ready(df: DataFrame, sink: str) -> DataFrame:
    """Values as the sink takes them: SQL Server no NaN, MySQL no zone."""
    for f in df.schema.fields:
        if sink == "mssql" and isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            df = df.withColumn(f.name, finite(F.col(f.name)))
        if sink == "mysql" and isinstance(f.dataType, T.TimestampType):
            df = df.withColumn(f.name, utc_naive(F.col(f.name)))
    return df
