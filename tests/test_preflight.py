"""What target types refuse, plain endpoints of one's own, and merges through checked stages."""

import datetime as dt
import decimal
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import cli
from tidemark.functions import convert
from tidemark.model import ColumnMeta
from tidemark.operators import preflight, scan
from tidemark.plans import connect
from tidemark.plans.config import Config, ConfigError, Endpoint, Migration, validate
from tidemark.plans.runner import ParquetSource, Runner
from tidemark.sources import jdbc


def refused(spark, kind, values, sink, target):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("x", kind)]))
    test = preflight.refusal(F.col("x"), kind, sink, target)
    return [] if test is None else [r["x"] for r in df.filter(test).collect()]


def test_texts_by_the_units_of_each_database(spark):
    odd = ["ab", "abc", "a\U0001f600", "éé", "", None]
    assert refused(spark, T.StringType(), odd, "postgres", "varchar(2)") == ["abc"]
    assert refused(spark, T.StringType(), odd, "mssql", "nvarchar(2)") == ["abc", "a\U0001f600"]
    assert refused(spark, T.StringType(), odd, "mssql", "nvarchar(max)") == []
    assert refused(spark, T.StringType(), ["é" * 32_768, "e" * 65_535], "mysql", "TEXT") == ["é" * 32_768]
    assert refused(spark, T.StringType(), ["a\0b", "ab"], "postgres", "text") == ["a\0b"]
    assert refused(spark, T.StringType(), ["a\0b", "ab"], "mysql", "LONGTEXT") == []
    assert refused(spark, T.StringType(), ["00112233-4455-6677-8899-AABBCCDDEEFF", "x", None], "mssql", "uniqueidentifier") == ["x"]
    assert refused(spark, T.StringType(), ['{"a": [1]}', "3", "{a", "", None], "postgres", "jsonb") == ["{a", ""]


def test_numbers(spark):
    assert refused(spark, T.LongType(), [-1, 0, 255, 256, None], "mssql", "tinyint") == [-1, 256]
    assert refused(spark, T.LongType(), [-(1 << 63), -32_768, 32_768], "postgres", "smallint") == [-(1 << 63), 32_768]
    assert refused(spark, T.LongType(), [-100, -99, 99, 100, -(1 << 63)], "mysql", "DECIMAL(4,2)") == [-100, 100, -(1 << 63)]
    assert refused(spark, T.DoubleType(), [9.994, 9.995, -9.995, float("nan"), None], "postgres", "numeric(3,2)")[:2] == [9.995, -9.995]
    assert len(refused(spark, T.DoubleType(), [1.0, float("nan"), float("inf"), float("-inf")], "mssql", "float")) == 3
    assert refused(spark, T.DoubleType(), [1.0, float("nan")], "postgres", "double precision") == []
    d = decimal.Decimal
    assert refused(spark, T.DecimalType(38, 3), [d("99.994"), d("99.995"), d("-1e30"), None], "mysql", "DECIMAL(4,2)") == [d("99.995"), d("-1e30")]
    assert preflight.refusal(F.col("x"), T.DecimalType(10, 2), "postgres", "numeric(12,4)") is None
    assert preflight.refusal(F.col("x"), T.LongType(), "postgres", "numeric(38,0)") is None
    assert refused(spark, T.BinaryType(), [b"abc", b"ab"], "mssql", "varbinary(2)") == [bytearray(b"abc")]


def test_dates(spark):
    days = [dt.date(999, 12, 31), dt.date(1000, 1, 1), None]
    assert refused(spark, T.DateType(), days, "mysql", "DATE") == days[:1]
    times = [dt.datetime(1752, 12, 31), dt.datetime(1753, 1, 1)]
    assert refused(spark, T.TimestampNTZType(), times, "mssql", "datetime") == times[:1]
    assert refused(spark, T.TimestampNTZType(), times, "mssql", "datetime2") == []


def test_fit_counts_nulls_and_odd_names(spark):
    df = spark.createDataFrame([("ab", 1), (None, 2), ("abc", None), ("abc", None)], "`a.b` string, `n` int")
    columns = (ColumnMeta("A.B", "varchar", 2), ColumnMeta("n", "int", nullable=False), ColumnMeta("absent", "int"))
    got = [tuple(r) for r in preflight.fit(df, columns, "mysql", "postgres").collect()]
    assert got == [("a.b", "varchar(2)", False, 4, 1, 2), ("n", "integer", False, 4, 2, 2)]
    assert [tuple(r)[3:] for r in preflight.fit(df.limit(0), columns, "mysql", "postgres").collect()] == [(0, 0, 0)] * 2
    rows = preflight.refused_rows(df, columns, "mysql", "postgres").collect()
    assert [r["refused_columns"] for r in rows] == [["a.b", "n"]] * 2
    assert preflight.fit(df, (), "mysql", "postgres").count() == 0 and preflight.refused_rows(df, (), "mysql", "postgres").count() == 0


def test_fit_is_one_small_aggregate(spark):
    df = spark.range(1000).withColumn("t", F.lit("abc"))
    plan = preflight.fit(df, (ColumnMeta("id", "bigint"), ColumnMeta("t", "varchar", 2)), "mssql", "mysql")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_count" in plan and "Python" not in plan


def test_marks_and_ordered_texts(spark):
    a = spark.createDataFrame([(1, dt.datetime(2024, 1, 2)), (2, None)], "id int, Updated timestamp_ntz")
    b = spark.createDataFrame([(1, "x")], "id int, updated string")
    assert [tuple(r) for r in scan.marks({"a": a, "b": b}, ["updated"]).collect()] == [("a", "Updated", dt.datetime(2024, 1, 2), 1)]
    assert scan.marks({"b": b}, ["updated"]).count() == 0
    rows = spark.createDataFrame([("g", 2, "b"), ("g", 1, "a"), ("g", 3, None), ("h", 1, None)], "k string, n int, `odd.name` string")
    got = {r["k"]: r["x"] for r in scan.ordered_texts(rows, ["k"], "odd.name", ["n"], "x").collect()}
    assert got["g"] == "a,b" and not got["h"]


def test_packed_only_where_smaller(spark):
    texts = ["a" * 63, "a" * 64, "".join(chr(33 + i) for i in range(80)), "é" * 40, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    packed = convert.packed_texts(df, "t")
    sizes = [None if r["t"] is None else len(r["t"]) - 4 for r in packed.orderBy("id").collect()]
    assert sizes[0] == 63 and sizes[1] < 64 and sizes[2] == 80 and sizes[3] < 80 and sizes[4] == 0 and sizes[5] is None
    assert [r["t"] for r in convert.unpacked_texts(packed, "t").orderBy("id").collect()] == texts


def settings(tmp_path, kind="parquet"):
    return Config(Endpoint(type=kind, path=f"file://{tmp_path}/src"), Endpoint(path=f"file://{tmp_path}/dst"), Migration())


def test_preflight_of_a_run(spark, tmp_path):
    spark.createDataFrame([(1, "a\0b"), (None, "ok")], "id int, t string").write.parquet(f"{tmp_path}/src/notes.parquet")
    config = settings(tmp_path)
    source = connect.source_of(spark, config.source)
    run = Runner(spark, config, source, connect.target_of(spark, config.target, "parquet"))
    got = {r["column_name"]: r["n_refused"] for r in run.preflight("postgres", "postgres").collect()}
    assert got == {"id": 0, "t": 1}
    assert {r["column_name"]: r["n_refused"] for r in run.preflight("postgres", "mysql").collect()} == {"id": 0, "t": 0}
    assert run.preflight("postgres", "parquet").count() == 0  # files take everything


def test_preflight_command(spark, tmp_path, capsys, monkeypatch):
    spark.createDataFrame([(1, "a\0b")], "id int, t string").write.parquet(f"{tmp_path}/src/notes.parquet")
    (tmp_path / "c.json").write_text(json.dumps({"source": {"path": f"file://{tmp_path}/src"}, "target": {"type": "pg", "host": "h", "database": "d", "user": "u"}}))
    monkeypatch.setattr("tidemark.plans.runner.Runner.run", lambda *a, **b: pytest.fail("nothing is copied"))
    assert cli.main(["--config", str(tmp_path / "c.json"), "preflight"]) == 4
    assert [(r["table_name"], r["column_name"], r["n_refused"]) for r in json.loads(capsys.readouterr().out)] == [("notes", "t", 1)]


def test_registered_endpoints(spark, tmp_path):
    class Numbers(ParquetSource):
        def tables(self):
            return []

    config = settings(tmp_path, "numbers")
    with pytest.raises(ConfigError):
        connect.source_of(spark, config.source)
    connect.register_source("numbers", lambda spark, end: Numbers(spark, end.path), "mysql")
    try:
        assert validate(config) is config and connect.types_of("numbers") == "mysql"
        target = connect.target_of(spark, config.target, "numbers")
        result = Runner(spark, config, connect.source_of(spark, config.source), target).run()
        assert result.status == "completed" and result.tables_total == 0
        connect.register_source("numbers", lambda spark, end: object())
        with pytest.raises(TypeError):
            connect.source_of(spark, config.source)
    finally:
        del connect._SOURCES["numbers"]
    db = jdbc.Database("postgres")
    for protocol, made in ((connect.Target, target), (connect.State, target.state()), (connect.Ledger, target.ledger()), (connect.Target, jdbc.JdbcTarget(spark, db, "s", "mssql"))):
        assert isinstance(made, protocol)
    assert connect.types_of("pg") == "postgres" and set(connect.kinds()["targets"]) == {"parquet", "mssql", "postgres", "mysql"}


class Changing(jdbc.JdbcTable):
    """Loses its first write of a stage, as a task that ran twice would double it."""

    writes = 0

    def count(self, name):
        self.writes += 1
        return super().count(name) + (self.writes == 1)


def test_merge_through_a_checked_stage(spark, tmp_path, monkeypatch):
    """Derby takes MERGE without a hint and a final semicolon; a stage that does not hold the rows is written again."""
    from tidemark.model import TableMeta
    from tidemark.plans import sqltext

    db = jdbc.Database("postgres", jdbc_url=f"jdbc:derby:{tmp_path}/merge;create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    form = lambda kind, schema, table, stage, columns, keys: f'MERGE INTO {table} AS t USING "{stage}" AS s ON t.id = s.id WHEN MATCHED THEN UPDATE SET v = s.v WHEN NOT MATCHED THEN INSERT (id, v) VALUES (s.id, s.v)'
    monkeypatch.setattr(sqltext, "merge", form)
    jdbc.execute(spark, db, ["CREATE TABLE nums (id INTEGER, v INTEGER)", "INSERT INTO nums VALUES (1, 1), (2, 2)"])
    table = Changing(spark, db, "", TableMeta("nums"), "postgres", ddl=False)
    changes = spark.createDataFrame([(2, 20), (3, 30)], "ID int, V int")
    assert table.merge(changes, ["ID"]) == 2 and table.writes == 2
    left = jdbc.query(spark, db, "SELECT id, v FROM nums").collect()
    assert sorted(tuple(r) for r in left) == [(1, 1), (2, 20), (3, 30)]
    tables = jdbc.query(spark, db, "SELECT tablename FROM sys.systables WHERE tabletype = 'T'").collect()
    assert [r[0] for r in tables] == ["NUMS"]
