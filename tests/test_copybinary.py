"""Binary COPY frames against Python's struct, and round trips in chunks of any size."""

import datetime as dt
import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import copybinary

KIND = "a boolean, b smallint, c int, d bigint, e float, f double, g string, h binary, i date, j timestamp_ntz, k decimal(20,6), l tinyint"
DOUBLES = [0.0, -0.0, 1.0, -1.5, 0.1, 1e308, -1e308, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, float("inf"), float("-inf"), float("nan"), 3.0, 2.0**-1022, 2.0**1023, 1 - 2.0**-53, 1 + 2.0**-52]


def same(a, b):
    return a == b or (a != a and b != b)


def data():
    rng = random.Random(4)
    rows = [(True, -1, 2**31 - 1, -(2**63), 1.5, -0.1, "é\n\t\\", b"\x00\xff", dt.date(1999, 12, 31), dt.datetime(1970, 1, 1, 0, 0, 0, 1), Decimal("-12345.678900"), -3), (None,) * 12]
    for _ in range(60):
        rows.append((rng.random() < 0.5, rng.randrange(-9, 9), rng.randrange(-(2**31), 2**31), rng.randrange(-(2**63), 2**63), float(rng.randrange(-999, 999)) / 8, rng.choice(DOUBLES), "x" * rng.randrange(70), bytes(rng.randrange(9)), dt.date(2000, 1, 1) + dt.timedelta(rng.randrange(-9999, 9999)), dt.datetime(2024, 2, 29, rng.randrange(24)), Decimal(rng.randrange(-(10**12), 10**12)).scaleb(-rng.randrange(0, 7)), rng.randrange(-128, 128)))
    return rows


def test_doubles_and_floats_bit_by_bit(spark):
    df = spark.createDataFrame([(x,) for x in DOUBLES + [random.Random(1).uniform(-1e9, 1e9) * 10.0**p for p in range(-300, 290, 7)]], "x double")
    for r in df.select("x", copybinary.big_endian(copybinary.double_bits(F.col("x")), 8).alias("b")).collect():
        assert bytes(r["b"]) == struct.pack(">d", r["x"]), r["x"]
    small = [0.0, -0.0, 1.1, -3.4e38, 1.4e-45, 1.1754944e-38, 1.17549421e-38, float("inf"), float("nan"), 16777216.0, 0.3]
    for r in spark.createDataFrame([(x,) for x in small], "x float").select("x", copybinary.big_endian(copybinary.float_bits(F.col("x")), 4).alias("b")).collect():
        assert bytes(r["b"]) == struct.pack(">f", r["x"]), r["x"]


def test_frames(spark):
    df = spark.createDataFrame([(7, "ab", None, True, dt.datetime(2000, 1, 1, 0, 0, 1))], "a int, b string, c bigint, d boolean, e timestamp_ntz")
    field = lambda b: struct.pack(">i", len(b)) + b
    want = struct.pack(">h", 5) + field(struct.pack(">i", 7)) + field(b"ab") + struct.pack(">i", -1) + field(b"\1") + field(struct.pack(">q", 1_000_000))
    assert bytes(df.select(copybinary.frame(df).alias("x")).first()[0]) == want
    with pytest.raises(ValueError):
        copybinary.frame(spark.createDataFrame([([1],)], "a array<int>"))


@pytest.mark.parametrize("size", [1, 7, 64, 10**6])
def test_a_stream_in_chunks_of_any_size(spark, size):
    rows = data()
    df = spark.createDataFrame(rows, KIND)
    stream = copybinary.HEADER + b"".join(bytes(r[0]) for r in df.select(copybinary.frame(df)).collect()) + copybinary.TRAILER
    pieces = (stream[i : i + size] for i in range(0, len(stream), size))
    got = [tuple(r.values()) for b in copybinary.rows_of(pieces, df.schema) for r in b.to_pylist()]
    assert len(got) == len(rows) and all(same(x, y) for a, b in zip(got, rows, strict=True) for x, y in zip(a, b, strict=True))


def test_streams_of_a_table(spark):
    df = spark.createDataFrame(data(), KIND).repartition(3)
    parts = copybinary.chunks(df)
    back = copybinary.read_chunks(parts, df.schema)
    key = lambda r: str(tuple(r))
    assert sorted(map(key, back.collect())) == sorted(map(key, df.collect()))
    empty = df.limit(0).repartition(2)
    assert copybinary.read_chunks(copybinary.chunks(empty), df.schema).count() == 0


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_whatever_the_session_says(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00' AS a, timestamp'2000-01-01 00:00:01 UTC' AS b, timestamp_ntz'1900-01-01 00:00:00.000001' AS c")
        micros = [int((dt.datetime(2024, 3, 10, 2, 30) - dt.datetime(2000, 1, 1)).total_seconds()) * 10**6, 10**6, -3155673600 * 10**6 + 1]
        want = struct.pack(">h", 3) + b"".join(struct.pack(">iq", 8, m) for m in micros)
        assert bytes(df.select(copybinary.frame(df)).first()[0]) == want
        assert copybinary.read_chunks(copybinary.chunks(df), df.schema).collect() == df.collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_broken_streams():
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    good = copybinary.HEADER + struct.pack(">hii", 1, 4, 9) + copybinary.TRAILER
    assert [b.to_pylist() for b in copybinary.rows_of([good], schema)] == [[{"a": 9}]]
    for bad in (b"x" * 40, good[:-4], good[:-2], copybinary.HEADER + struct.pack(">hiiii", 2, 4, 9, 4, 9) + copybinary.TRAILER, copybinary.HEADER + struct.pack(">hiq", 1, 8, 9) + copybinary.TRAILER):
        with pytest.raises(ValueError):
            list(copybinary.rows_of([bad], schema))
