"""Rows as frames of PostgreSQL's binary COPY, and back.

Frames are made by column expressions: a count of fields, then for each its length and its bytes, most significant
first. A stream is a header, frames and a trailer, cut into chunks of any size. Reading takes chunks in order: what a chunk leaves
unfinished waits for the next. The fields of all rows that are whole are found and decoded by array operations, column by column.

Text and binary columns, booleans, 16 to 64 bit integers, floats, dates, times without zone (UTC times with zone) and
decimals have frames; other types are refused. Nulls have length -1. NUL characters, which no text of the database holds, go.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.convert import days_since_2000, micros_since_2000, signed_base10000

# Signature, flags and length of the header's extension; the trailer.
HEADER = b"PGCOPY\n\xff\r\n\x00" + bytes(8)
TRAILER = b"\xff\xff"
_EPOCH_DAYS, _EPOCH_MICROS = 10_957, 946_684_800_000_000


def big_endian(c: Column, size: int) -> Column:
    """The last ``size`` bytes of an integer."""
    return F.unhex(F.right(F.lpad(F.hex(c.cast("long")), 16, "0"), F.lit(2 * size)))


def double_bits(c: Column) -> Column:
    """The 64 bits of a double as a long, from its sign, exponent and fraction."""
    x = c.cast("double")
    size = F.abs(x)
    guess = F.floor(F.log2(size)).cast("long")
    # The logarithm may be off by one at powers of two.
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    e = guess + F.when(power(guess) > size, -1).when(power(guess + 1) <= size, 1).otherwise(0)
    half = F.floor(e / 2)
    whole = F.shiftleft(e + 1023, 52) + ((size / power(half) / power(e - half) - 1) * float(1 << 52)).cast("long")
    small = (size * 2.0**537 * 2.0**537).cast("long")
    inf = F.lit(0x7FF0 << 48).cast("long")
    value = F.when(F.isnan(x), F.lit(0x7FF8 << 48)).when(size == float("inf"), inf).when(size >= 2.0**-1022, whole).otherwise(small)
    return F.when(F.startswith(x.cast("string"), F.lit("-")), value.bitwiseOR(F.lit(-(1 << 63)))).otherwise(value)


def float_bits(c: Column) -> Column:
    """The 32 bits of a float as a long: those of the double it equals, with fewer for exponent and fraction."""
    x = c.cast("double")
    size = F.abs(x)
    bits = double_bits(size)
    normal = F.shiftright(bits, 29) - F.lit((1023 - 127) << 23)
    small = (size * 2.0**149).cast("long")
    value = F.when(F.isnan(x), F.lit(0x7FC00000)).when(size == float("inf"), F.lit(0x7F800000)).when(size >= 2.0**-126, normal).otherwise(small)
    return F.when(F.startswith(x.cast("string"), F.lit("-")), value + F.lit(1 << 31)).otherwise(value)


def _numeric(c: Column, kind: T.DecimalType) -> Column:
    n = signed_base10000(c, kind.scale)
    digits = F.concat(F.lit(""), F.array_join(F.transform(n["digits"], lambda d: F.right(F.lpad(F.hex(d.cast("long")), 16, "0"), F.lit(4))), ""))
    return F.concat(big_endian(F.size(n["digits"]), 2), big_endian(n["weight"], 2), F.when(n["negative"], F.unhex(F.lit("4000"))).otherwise(F.unhex(F.lit("0000"))), big_endian(n["scale"], 2), F.unhex(digits))


def field_bytes(c: Column, kind: T.DataType) -> Column:
    """A value as the database sends it; null stays null."""
    if isinstance(kind, T.BooleanType):
        return big_endian(c.cast("int"), 1)
    for t, size in ((T.ByteType, 2), (T.ShortType, 2), (T.IntegerType, 4), (T.LongType, 8)):
        if isinstance(kind, t):
            return big_endian(c, size)
    if isinstance(kind, T.FloatType):
        return big_endian(float_bits(c), 4)
    if isinstance(kind, T.DoubleType):
        return big_endian(double_bits(c), 8)
    if isinstance(kind, T.DateType):
        return big_endian(days_since_2000(c), 4)
    if isinstance(kind, T.TimestampNTZType):
        # By its parts: a difference of clock times would skip what the session's zone skips.
        clock = (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
        return big_endian(days_since_2000(c).cast("long") * 86_400_000_000 + clock, 8)
    if isinstance(kind, T.TimestampType):
        return big_endian(micros_since_2000(c), 8)
    if isinstance(kind, T.DecimalType):
        return _numeric(c, kind)
    if isinstance(kind, T.BinaryType):
        return c
    if isinstance(kind, T.StringType):
        return F.replace(c, F.lit("\0"), F.lit("")).cast("binary")
    raise ValueError(f"no binary form of {kind.simpleString()}")


def frame(df: DataFrame) -> Column:
    """A row of ``df`` as one frame."""
    parts = [big_endian(F.lit(len(df.columns)), 2)]
    for f in df.schema.fields:
        value = field_bytes(F.col(f.name), f.dataType)
        parts.append(F.when(F.col(f.name).isNull(), F.unhex(F.lit("FFFFFFFF"))).otherwise(F.concat(big_endian(F.octet_length(value), 4), value)))
    return F.concat(*parts)


def chunks(df: DataFrame) -> DataFrame:
    """(stream, chunk, content): one stream for each partition of ``df``, each with header and trailer."""

    def work(batches):
        from pyspark import TaskContext

        stream, chunk, held = TaskContext.get().partitionId(), 0, [HEADER]
        for batch in batches:
            held += batch.column(0).to_pylist()
            yield _chunk(stream, chunk, b"".join(held))
            chunk, held = chunk + 1, []
        yield _chunk(stream, chunk, b"".join([*held, TRAILER]))

    return df.select(frame(df).alias("frame")).mapInArrow(work, "stream int, chunk int, content binary")


def _chunk(stream: int, chunk: int, content: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([stream], pa.int32()), pa.array([chunk], pa.int32()), pa.array([content], pa.binary())], names=["stream", "chunk", "content"])


class Splitter:
    """Takes the chunks of one stream in order; gives the whole rows of each: bytes, and by column where fields begin and their lengths."""

    def __init__(self, fields: int):
        self.fields, self.rest, self.begun, self.ended = fields, b"", False, False

    def __call__(self, chunk: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = self.rest + chunk
        if not self.begun:
            if len(data) < len(HEADER):
                self.rest = data
                return self._none()
            if data[:11] != HEADER[:11]:
                raise ValueError("not a binary COPY stream")
            skip = 19 + int.from_bytes(data[15:19], "big")
            if len(data) < skip:
                self.rest = data
                return self._none()
            data, self.begun = data[skip:], True
        raw = np.frombuffer(data, np.uint8)
        n = len(raw)
        if n < 2:
            self.rest = data
            return self._none()
        # As if a field began at each byte: where it would end. Past the data there is one place that nothing leaves.
        size = np.full(n, n + 1, np.int64)
        if n >= 4:
            wide = raw.astype(np.int64)
            length = (wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]).astype(np.uint32).view(np.int32).astype(np.int64)
            size[: n - 3] = np.minimum(np.arange(n - 3) + 4 + np.maximum(length, 0), n + 1)
        end = np.append(size, [n + 1, n + 1])
        end[n] = n + 1
        after = np.minimum(np.arange(n) + 2, n + 1)
        for _ in range(self.fields):
            after = end[after]
        follow, starts, at = after.tolist(), [], 0
        while at < n:
            if data[at : at + 2] == TRAILER:
                self.ended = True
                break
            if follow[at] > n:
                break
            if int.from_bytes(data[at : at + 2], "big") != self.fields:
                raise ValueError(f"a row of {int.from_bytes(data[at : at + 2], 'big')} fields, not {self.fields}")
            starts.append(at)
            at = follow[at]
        self.rest = b"" if self.ended else data[at:]
        place = np.array(starts, np.int64) + 2
        begins, lengths = np.empty((self.fields, len(starts)), np.int64), np.empty((self.fields, len(starts)), np.int64)
        for i in range(self.fields):
            begins[i], lengths[i] = place + 4, length[place] if len(starts) else 0
            place = end[place]
        return raw, begins, lengths

    def _none(self):
        nothing = np.zeros((self.fields, 0), np.int64)
        return np.zeros(0, np.uint8), nothing, nothing

    def close(self) -> None:
        if not self.ended:
            raise ValueError("the stream ends within a row")


def _gather(raw: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of fields, one after another, and offsets."""
    lengths = np.maximum(lengths, 0)
    offsets = np.append(0, np.cumsum(lengths))
    at = np.arange(offsets[-1]) + np.repeat(begins - offsets[:-1], lengths)
    return raw[at], offsets


def _integers(raw: np.ndarray, begins: np.ndarray, there: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(begins), np.uint64)
    at = np.where(there, begins, 0)
    for i in range(size):
        out = out << np.uint64(8) | np.where(there, raw[np.minimum(at + i, len(raw) - 1)], 0).astype(np.uint64)
    return out


def decode(raw: np.ndarray, begins: np.ndarray, lengths: np.ndarray, kind: T.DataType) -> pa.Array:
    """One column of whole rows."""
    there = lengths >= 0
    if isinstance(kind, (T.StringType, T.BinaryType)):
        data, offsets = _gather(raw, begins, lengths)
        mask = pa.array(there).buffers()[1]
        found = pa.Array.from_buffers(pa.large_binary(), len(begins), [mask, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        return found.cast(pa.large_string()).cast(pa.string()) if isinstance(kind, T.StringType) else found.cast(pa.binary())
    if isinstance(kind, T.DecimalType):
        return _decimals(raw, begins, lengths, kind)
    size = {"boolean": 1, "tinyint": 2, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8}[kind.simpleString()]
    if bad := int(np.count_nonzero(there & (lengths != size))):
        raise ValueError(f"{bad} values of {kind.simpleString()} that do not have {size} bytes")
    bits = _integers(raw, begins, there, size)
    signed = bits.astype({1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[size]).view({1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[size])
    name = kind.simpleString()
    if name == "boolean":
        return pa.array(signed != 0, pa.bool_(), mask=~there)
    if name in ("float", "double"):
        return pa.array(signed.view(np.float32 if size == 4 else np.float64), mask=~there)
    if name == "date":
        return pa.array((signed + _EPOCH_DAYS).astype(np.int32), pa.int32(), mask=~there).cast(pa.date32())
    if name.startswith("timestamp"):
        whole = pa.array(signed + _EPOCH_MICROS, pa.int64(), mask=~there)
        return whole.cast(pa.timestamp("us", "UTC" if name == "timestamp" else None))
    return pa.array(signed.astype(np.int8) if name == "tinyint" else signed, mask=~there)


def _decimals(raw: np.ndarray, begins: np.ndarray, lengths: np.ndarray, kind: T.DecimalType) -> pa.Array:
    """Digits of all values at once, as four characters each; only the last step is one value at a time."""
    from decimal import Decimal

    there = lengths >= 0
    head = [_integers(raw, begins + 2 * i, there, 2).astype(np.uint16) for i in range(4)]
    digits, weight, negative = head[0].astype(np.int64), head[1].view(np.int16).astype(np.int64), head[2] == 0x4000
    if np.count_nonzero(there & (head[2] >= 0xC000)):
        raise ValueError("NaN and infinities are no decimals")
    of = np.repeat(np.arange(len(begins)), digits)
    place = np.arange(len(of)) - np.repeat(np.cumsum(digits) - digits, digits)
    value = _integers(raw, begins[of] + 8 + 2 * place, np.ones(len(of), bool), 2).astype(np.int64)
    # Each group counts 10000 ** (weight - place); of a value with this scale none is under the last decimal.
    text = np.char.zfill(value.astype("U4"), 4) if len(value) else np.zeros(0, "U4")
    ends = np.cumsum(digits)
    out = []
    for i in range(len(begins)):
        if not there[i]:
            out.append(None)
            continue
        whole = "".join(text[ends[i] - digits[i] : ends[i]].tolist()) or "0"
        number = Decimal(int(whole)).scaleb(int(4 * (weight[i] - digits[i] + 1)))
        out.append((-number if negative[i] else number).quantize(Decimal(1).scaleb(-kind.scale)))
    return pa.array(out, pa.decimal128(kind.precision, kind.scale))


def rows_of(contents: Iterable[bytes], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Rows of one stream, batch by batch."""
    split = Splitter(len(schema))
    for content in contents:
        raw, begins, lengths = split(content)
        if begins.shape[1]:
            yield pa.RecordBatch.from_arrays([decode(raw, begins[i], lengths[i], f.dataType) for i, f in enumerate(schema.fields)], names=schema.fieldNames())
    split.close()


def read_chunks(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of streams (stream, chunk, content); a stream's chunks meet in one task, in order, and one is held at a time."""

    def work(batches):
        def streams():
            for batch in batches:
                yield from zip(batch.column("stream").to_pylist(), batch.column("content"), strict=True)

        import itertools

        for _, own in itertools.groupby(streams(), key=lambda x: x[0]):
            yield from rows_of((c.as_py() for _, c in own), schema)

    dealt = df.repartition("stream").sortWithinPartitions("stream", "chunk").select("stream", "content")
    return dealt.mapInArrow(work, schema)
