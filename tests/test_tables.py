"""Operators, state, sources and runs on small tables."""

import datetime as dt
import json
import os
import threading
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import convert, tolerant
from tidemark.model import ParquetCatalog
from tidemark.operators import constraints, hashtree, merge, partition, scan, splits, verify
from tidemark.plans import sqltext
from tidemark.plans.config import Config, Endpoint, Migration
from tidemark.plans.runner import FolderTarget, JdbcSource, ParquetSource, Runner
from tidemark.sources import jdbc
from tidemark.sources.files import VersionedTable, write_tsv
from tidemark.streaming import state as states

NAN = float("nan")


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.fixture
def sides(spark):
    kind = "id int, a string, b double"
    target = spark.createDataFrame([(1, "x", 1.0), (2, "x", 1.0), (3, None, 1.0), (4, "x", None), (5, "x", NAN), (9, "t", 0.0)], kind)
    source = spark.createDataFrame([(1, "x", 1.0), (2, "y", 1.0), (3, "x", 1.0), (4, None, None), (5, "x", NAN), (7, "n", 2.0)], kind)
    return target, source


def test_classify(sides):
    found = dict(merge.classify(*sides, ["id"]).select("id", "action").collect())
    assert found == {1: "noop", 2: "update", 3: "update", 4: "update", 5: "noop", 7: "insert", 9: "keep"}


def test_upsert_overwrites_with_null_and_repeats(sides):
    target, source = sides
    once = merge.upsert(target, source, ["id"])
    assert dict(once.select("id", "a").collect())[4] is None
    assert {r["id"] for r in once.collect()} == {1, 2, 3, 4, 5, 7, 9}
    assert list(map(str, rows(merge.upsert(once, source, ["id"])))) == list(map(str, rows(once)))


def test_upsert_takes_the_latest_of_a_key(spark):
    target = spark.createDataFrame([(1, "a", 0)], "id int, v string, seq int")
    source = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 1)], "id int, v string, seq int")
    assert rows(merge.upsert(target, source, ["id"], [F.desc("seq")])) == [(1, "c", 2), (2, "d", 1)]


def test_upsert_needs_a_key(sides):
    with pytest.raises(merge.NoPrimaryKey):
        merge.upsert(*sides, [])


def test_keys_only(spark):
    a, b = (spark.createDataFrame([(i,) for i in x], "id int") for x in ([1, 2], [2, 3, 3]))
    assert rows(merge.upsert(a, b, ["id"])) == [(1,), (2,), (3,)]


@pytest.mark.parametrize("keys, parts", [([], 3), ([5], 4), ([-3, -1, 0, 2, 7, 7, 9], 3), (list(range(50)), 7), ([-(2**63), 2**63 - 1], 2)])
def test_ntile(spark, keys, parts):
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)
    assert rows(partition.ntile_bounds(df, "k", parts)) == rows(partition.ntile_bounds_single(df, "k", parts))


def test_pages_make_the_table(spark):
    df = spark.createDataFrame([(k,) for k in range(-5, 20)], "k long")
    seen, last = [], None
    while page := [r["k"] for r in scan.keyset_page(df, "k", 7, after=last).collect()]:
        seen += page
        last = page[-1]
    assert seen == list(range(-5, 20))


def test_watermark_is_strict_and_takes_nulls(spark):
    df = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2024-01-01 00:00:00.123'), (2, timestamp_ntz'2024-01-01 00:00:00.124'), (3, null) AS t(id, at)")
    got = scan.watermark_filter(df, "at", dt.datetime(2024, 1, 1, 0, 0, 0, 123_900), now=dt.datetime(2024, 2, 1))
    assert [r["id"] for r in got.orderBy("id").collect()] == [2, 3]
    assert scan.watermark_filter(df, "at", dt.datetime(2030, 1, 1), now=dt.datetime(2024, 2, 1)).count() == 3
    assert scan.pick_watermark_column(df, ["nope", "AT"]) == ("at", False)


@pytest.mark.parametrize(
    "ranges, start, key",
    [
        ([], None, None),
        ([(0, 100)], 0, 100),
        ([(0, 100), (100, 200), (200, 300)], 0, 300),
        ([(0, 100), (200, 300)], 0, 100),
        ([(200, 300), (0, 100), (100, 200)], 0, 300),
        ([(500, 600)], 0, None),
        ([(500, 600)], 500, 600),
        ([(0, 150), (100, 200)], 0, 200),
        ([(None, 50), (50, 80)], None, 80),
    ],
)
def test_resume_point(spark, ranges, start, key):
    df = spark.createDataFrame(ranges, "range_start long, range_end long")
    found = states.resume_point(df, start).collect()
    assert (found[0]["resume_key"] if found else None) == key


def test_constraints(spark):
    child = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id int, parent int")
    parent = spark.createDataFrame([(1,)], "id int")
    assert [r["id"] for r in constraints.fk_orphans(child, ["parent"], parent, ["id"]).collect()] == [2]
    assert dict(constraints.null_violations(child, ["id", "parent"]).collect()) == {"id": 0, "parent": 1}
    assert [r["id"] for r in constraints.check_violations(child, "[parent] < 5").collect()] == [2]
    assert constraints.next_sequence(child.filter("id > 5"), "id").first()[0] == 1
    assert constraints.next_sequence(child, "id", "postgres").first()[0] == 3


def test_hash_diff(sides):
    target, source = sides
    found = dict(verify.hash_diff(source, target, ["id"], ["a"]).collect())
    assert found == {2: "different", 3: "different", 4: "different", 7: "missing", 9: "extra"}
    assert rows(verify.tiered(source, target, ["id"], ["a"], 2)) == rows(verify.hash_diff(source, target, ["id"], ["a"]))


def test_escapes_and_sizes(spark):
    df = spark.createDataFrame([("a\tb\n\\\r\0",), (None,), ("\U0001f600",), ("x" * 32_768,)], "t string")
    out = [r[0] for r in df.select(convert.escape_tsv(F.col("t"))).collect()]
    assert out[0] == "a\\tb\\n\\\\\\r\\0" and out[1] == "\\N"
    assert [r[0] for r in df.select(convert.utf16_bytes(F.col("t"))).collect()] == [14, None, 4, 65_536]
    assert convert.route_oversized(df)[1].count() == 1
    assert df.select(convert.copy_text(F.lit(True), spark.range(1).selectExpr("true AS b").schema["b"].dataType)).first()[0] == "t"


def test_sinks_get_what_they_take(spark):
    df = spark.createDataFrame([(NAN,), (float("inf"),), (1.5,)], "x double")
    assert rows(convert.sink_ready(df, "mssql")) == [(1.5,), (None,), (None,)]
    assert spark.range(1).select(convert.base10000(F.lit("123450000").cast("decimal(20,0)"))).first()[0] == [1, 2345, 0]


def test_state(spark):
    at = dt.datetime(2024, 1, 1)
    row = ["r", "h", at, None, "running", "t", "completed", 5, 5, 0, None, at, at, None, at]
    one = spark.createDataFrame([row], states.SCHEMA)
    once = states.save(states.empty(spark), one)
    assert rows(states.save(once, one)) == rows(once)
    assert states.resumable_run(once, "h").count() == 1
    assert states.resumable_run(once.withColumn("run_status", F.lit("completed")), "h").count() == 0
    assert states.last_sync(once).first()["last_sync_timestamp"] == at


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    assert not t.exists()
    t.publish(spark.range(3).toDF("k"))
    t.append(spark.range(3, 5).toDF("k"))
    t.publish(merge.upsert(t.read(), spark.range(4, 7).toDF("k"), ["k"]))
    assert [r[0] for r in t.read().orderBy("k").collect()] == list(range(7))
    t.drop()
    assert not t.exists()


def test_readers_keep_the_version_they_began_with(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.publish(spark.range(3).toDF("k"))
    old = t.read()
    t.append(spark.range(3, 5).toDF("k"))
    assert old.count() == 3 and t.read().count() == 5
    t.publish(spark.range(9).toDF("k"))
    assert t.read().count() == 9 and t.version() == 3
    t.publish(spark.range(1).toDF("k"))
    left = [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("data-")]
    assert len(left) == 2 and len(list((tmp_path / "t" / "_pointers").glob("[0-9]*"))) == 2


def test_a_crash_before_the_pointer_leaves_the_table(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.publish(spark.range(3).toDF("k"))
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "point", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            t.publish(spark.range(100).toDF("k"))
    assert t.exists() and t.read().count() == 3


def test_values_with_bars_do_not_hash_alike(spark):
    a = spark.createDataFrame([(1, "a|vb", "c"), (2, "x", "y"), (3, "a\\", "|v")], "id int, x string, y string")
    b = spark.createDataFrame([(1, "a", "b|vc"), (2, "x", "y"), (3, "a\\|v", "")], "id int, x string, y string")
    assert dict(verify.hash_diff(a, b, ["id"], ["x", "y"]).collect()) == {1: "different", 3: "different"}


@pytest.mark.parametrize("zone", ["America/New_York", "UTC", "Asia/Tokyo"])
def test_watermarks_are_instants_whatever_the_session_says(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 08:00:00Z'), (2, timestamp'2024-01-01 10:00:00Z'), (3, timestamp'2024-01-01 12:00:00Z'), (4, null) AS t(id, at)")
        got = scan.watermark_filter(df, "at", dt.datetime(2024, 1, 1, 10), now=dt.datetime(2024, 2, 1))
        assert sorted(r["id"] for r in got.collect()) == [3, 4]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_decimals_go_to_groups_of_four_and_back(spark):
    import decimal

    values = ["0", "1", "-1", "9999", "10000", "-123456789.0125", "0.0001", "-0.00000001", "5.5", "100000000.00000001", None]
    df = spark.createDataFrame([(decimal.Decimal(v) if v else None,) for v in values], "d decimal(38,8)")
    packed = df.select("d", convert.signed_base10000(F.col("d"), 8).alias("p"))
    got = packed.select("d", convert.decimal_text(F.col("p.digits"), F.col("p.weight"), F.col("p.negative"), F.col("p.scale")).alias("t")).collect()
    assert all((r["t"] is None) if r["d"] is None else decimal.Decimal(r["t"]) == r["d"] for r in got)
    one = spark.sql("SELECT array(12, 3400) AS digits, 0 AS weight, true AS negative, 2 AS scale, array(5) AS few, -2 AS low, 9 AS deep")
    assert one.select(convert.decimal_text(F.col("digits"), F.col("weight"), F.col("negative"), F.col("scale"))).first()[0] == "-12.34"
    assert one.select(convert.decimal_text(F.col("few"), F.col("low"), F.lit(False), F.col("deep"))).first()[0] == "0.000000050"


def test_uuids(spark):
    text = "00112233-4455-6677-8899-aabbccddeeff"
    df = spark.createDataFrame([(text,)], "u string").select(convert.uuid_bytes(F.col("u")).alias("b"))
    assert df.select(convert.uuid_text(F.col("b"))).first()[0] == text
    assert spark.sql("SELECT X'00' AS b").select(convert.uuid_text(F.col("b"))).first()[0] is None


def test_packed_texts_come_back(spark):
    df = spark.createDataFrame([(1, "a" * 5000), (2, None), (3, ""), (4, "é\U0001f600")], "id int, t string")
    packed = convert.packed_texts(df, "t")
    assert len(packed.filter("id = 1").first()["t"]) < 200 and packed.dtypes[1] == ("t", "binary")
    assert rows(convert.unpacked_texts(packed, "t")) == rows(df)


def test_catalog_parts_make_tables(spark):
    parts = {
        "columns": [("t", "id", "int", None, 32, 0, "NO", 1, 1), ("t", "p", "varchar", 50, None, None, "YES", 2, 0), ("t", "at", "timestamp", None, None, None, "YES", 3, 0), ("u", "k", "int", None, None, None, "NO", 1, 0)],
        "keys": [("t", "p", 2), ("t", "id", 1)],
        "rows": [("t", 12), ("u", -1)],
        "references": [("t", "fk2", 2, "p", "u", "k2", "NO_ACTION", "CASCADE"), ("t", "fk2", 1, "id", "u", "k", "NO_ACTION", "CASCADE"), ("t", "fk1", 1, "p", "v", "k", "SET NULL", "NO ACTION")],
        "checks": [("t", "c1", "(id > 0)")],
        "indexes": [("t", "ix", 1, 2, "id", 0), ("t", "ix", 1, 1, "p", 0), ("t", "ix", 1, 3, "at", 1)],
    }
    t, u = jdbc.assemble({n: spark.createDataFrame(parts[n], kind) for n, kind in jdbc._PARTS.items()}, "s")
    assert (t.key, t.rows, u.rows, u.key) == (("id", "p"), 12, 0, ()) and [c.identity for c in t.columns] == [True, False, False]
    fk1, fk2 = t.foreign_keys
    assert (fk1.parent, fk1.on_delete) == ("v", "SET NULL") and (fk2.columns, fk2.parent_columns, fk2.on_delete, fk2.on_update) == (("id", "p"), ("k", "k2"), "NO ACTION", "CASCADE")
    assert (t.indexes[0].columns, t.indexes[0].included, t.indexes[0].unique) == (("p", "id"), ("at",), True)
    assert t.checks[0].definition == "(id > 0)" and u.indexes == u.foreign_keys == u.checks == ()
    for kind in ("postgres", "mysql", "mssql"):
        assert set(jdbc._CATALOG[kind]) <= set(jdbc._PARTS) and all("{schema}" in q for q in jdbc._CATALOG[kind].values())
        assert "BASE TABLE" in jdbc._CATALOG[kind]["columns"] and "{kind}" not in jdbc._CATALOG[kind]["columns"]


def test_catalog_of_a_database_reaches_keys_and_finalisation(spark, tmp_path, monkeypatch):
    """Derby's own catalog stands for PostgreSQL's: identity, key, index, reference and check are loaded, made and enforced."""
    db = jdbc.Database("postgres", jdbc_url=f"jdbc:derby:{tmp_path}/cat;create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    make = ['CREATE TABLE "par" ("id" INT NOT NULL)', 'CREATE TABLE "chi" ("id" INT NOT NULL, "p" INT, "v" INT)', 'INSERT INTO "par" VALUES 1', 'INSERT INTO "chi" VALUES (1, 1, 5)', 'CREATE VIEW "vw" AS SELECT * FROM "par"']
    jdbc.execute(spark, db, make)
    owned = "FROM SYS.SYSTABLES t JOIN SYS.SYSSCHEMAS s ON s.SCHEMAID = t.SCHEMAID WHERE t.TABLETYPE = 'T' AND s.SCHEMANAME = {schema}"
    columns = owned.replace("WHERE", "JOIN SYS.SYSCOLUMNS c ON c.REFERENCEID = t.TABLEID WHERE")
    kinds = "CASE WHEN c.COLUMNNAME = 'id' THEN 1 ELSE 0 END"
    fake = {
        "columns": f"SELECT t.TABLENAME AS table_name, c.COLUMNNAME AS column_name, 'int4' AS data_type, 0 AS character_maximum_length, 0 AS numeric_precision, 0 AS numeric_scale, CASE WHEN c.COLUMNNAME = 'id' THEN 'NO' ELSE 'YES' END AS is_nullable, c.COLUMNNUMBER AS ordinal_position, {kinds} AS is_identity {columns}",
        "keys": f"SELECT t.TABLENAME AS table_name, 'id' AS column_name, 1 AS ordinal_position {owned}",
        "references": f"SELECT t.TABLENAME AS table_name, 'fk' AS name, 1 AS ordinal_position, 'p' AS column_name, 'par' AS parent, 'id' AS parent_column, 'NO_ACTION' AS on_delete, 'NO_ACTION' AS on_update {owned} AND t.TABLENAME = 'chi'",
        "checks": f"SELECT t.TABLENAME AS table_name, 'ck' AS name, '([v] > 0)' AS definition {owned} AND t.TABLENAME = 'chi'",
        "indexes": f"SELECT t.TABLENAME AS table_name, 'ix' AS name, 1 AS is_unique, 1 AS ordinal_position, 'v' AS column_name, 0 AS is_included {owned} AND t.TABLENAME = 'chi'",
    }
    monkeypatch.setitem(jdbc._CATALOG, "postgres", fake)
    tables = jdbc.load_catalog(spark, db, "APP")
    assert [t.name for t in tables] == ["chi", "par"]
    refused = jdbc.JdbcTarget(spark, db, "APP", "postgres").finalise(tables)
    assert {r["constraint"] for r in refused} == {"sequence"}  # Derby has no setval
    for bad in ("VALUES (1, 1, 6)", "VALUES (2, 9, 6)", "VALUES (2, 1, 5)", "VALUES (2, 1, -1)"):
        with pytest.raises(Exception):
            jdbc.execute(spark, db, [f'INSERT INTO "chi" {bad}'])
    jdbc.execute(spark, db, ['INSERT INTO "chi" VALUES (2, 1, 6)'])
    table = jdbc.JdbcTarget(spark, db, "APP", "postgres").table(tables[0])
    assert table.has_primary_key() and table.exists()


def test_deadlocks_are_retried(monkeypatch):
    class Dead(Exception):
        pass

    turns = []

    def work():
        turns.append(1)
        if len(turns) < 3:
            raise Dead("deadlock")
        return "done"

    monkeypatch.setattr(jdbc, "deadlocked", lambda e: isinstance(e, Dead))
    assert jdbc.retried(work, wait=0) == "done" and len(turns) == 3
    with pytest.raises(ValueError):
        jdbc.retried(lambda: (_ for _ in ()).throw(ValueError("other")), wait=0)


def test_tsv(spark, tmp_path):
    write_tsv(spark.createDataFrame([("a\tb", None, 1)], "x string, y string, z int"), f"file://{tmp_path}/o")
    assert [r[0] for r in spark.read.text(f"file://{tmp_path}/o").collect()] == ["a\\tb\t\\N\t1"]


def test_stream(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.publish(spark.createDataFrame([(1, "a")], "id int, v string"))
    for i, part in enumerate(([(1, "b", 1), (1, "c", 2)], [(2, "d", 1)])):
        spark.createDataFrame(part, "id int, v string, seq int").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    changes = spark.readStream.schema("id int, v string, seq int").parquet(f"file://{tmp_path}/in")
    states.SyncStream(t.read, t.publish, ["id"], [F.desc("seq")]).start(changes, f"file://{tmp_path}/cp", once=True).awaitTermination()
    assert rows(t.read()) == [(1, "c"), (2, "d")]


def test_jdbc(spark, tmp_path):
    db = jdbc.Database("mssql", jdbc_url=f"jdbc:derby:{tmp_path}/db;create=true", driver="org.apache.derby.jdbc.EmbeddedDriver")
    keys = [-(2**63), -7, 0, 3, 4, 90, 2**63 - 1]
    jdbc.write_table(spark.createDataFrame([(k, str(k)) for k in keys], "K long, V string"), db, "T", mode="overwrite")
    got = jdbc.read_table(spark, db, "T", "K", 3)
    assert got.rdd.getNumPartitions() == 3
    assert sorted(r["K"] for r in got.collect()) == keys
    assert jdbc.check(spark, db, "SELECT 1 AS ONE FROM SYSIBM.SYSDUMMY1")[0]
    assert not jdbc.check(spark, jdbc.Database("mssql", jdbc_url=f"jdbc:derby:{tmp_path}/none", driver=db.driver))[0]


@pytest.fixture
def folder(spark, tmp_path):
    root = f"file://{tmp_path}/src"
    spark.createDataFrame([(0, "r")], "r_regionkey int, r_name string").write.parquet(f"{root}/region.parquet")
    spark.createDataFrame([(1, "n", 0), (2, "m", 5)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{root}/nation.parquet")
    return root


def _runner(spark, folder, tmp_path, mode, **options):
    config = Config(Endpoint(path=folder), Endpoint(path=f"file://{tmp_path}/dst"), Migration(target_mode=mode, **options))
    return Runner(spark, config, ParquetSource(spark, folder), FolderTarget(spark, config.target.path))


def test_runs(spark, folder, tmp_path):
    dry = _runner(spark, folder, tmp_path, "drop_recreate").run(dry=True)
    assert (dry.status, dry.tables_total, dry.exit_code()) == ("dry_run", 2, 0)
    full = _runner(spark, folder, tmp_path, "drop_recreate").run()
    assert (full.status, full.tables_success, full.rows_transferred) == ("completed", 2, 3)
    assert full.violations == [{"table": "nation", "constraint": "fk_n_regionkey", "rows": 1}]
    again = _runner(spark, folder, tmp_path, "upsert", exclude_tables=["reg*"]).run()
    assert (again.status, again.tables_total) == ("completed", 1)
    assert again.run_id != full.run_id
    r = _runner(spark, folder, tmp_path, "upsert")
    assert [(x["table_name"], x["is_match"]) for x in r.validate().orderBy("table_name").collect()] == [("nation", True), ("region", True)]
    assert r.health()["healthy"]
    assert json.dumps(full.as_dict())


class Halting(FolderTarget):
    """Fails, or stops the run, before the n-th range is written."""

    def __init__(self, spark, root, at, stop=None):
        super().__init__(spark, root)
        self.at, self.stop, self.staged = at, stop, []

    def table(self, meta):
        outer = self

        class Table(VersionedTable):
            def stage(self, df, run, part):
                if len(outer.staged) == outer.at:
                    if outer.stop:
                        outer.stop()
                    else:
                        raise OSError("disk gone")
                outer.staged.append(part)
                return super().stage(df, run, part)

        return Table(self.spark, f"{self.root}/{meta.name}")


@pytest.mark.parametrize("how", ["error", "cancel"])
def test_a_run_goes_on_from_the_ranges_it_had_copied(spark, tmp_path, how):
    root = f"file://{tmp_path}/src"
    rows_of = [(k, f"c{k}", k % 7) for k in [-5, *range(0, 40), 1000]] + [(None, "none", 0)]
    spark.createDataFrame(rows_of, "c_custkey long, c_name string, c_nationkey int").repartition(3).write.parquet(f"{root}/customer.parquet")
    spark.createDataFrame([(0, "r")], "r_regionkey int, r_name string").write.parquet(f"{root}/region.parquet")
    config = Config(Endpoint(path=root), Endpoint(path=f"file://{tmp_path}/dst"), Migration(target_mode="drop_recreate", chunk_size=5, parallel_readers=6, workers=1))
    target = Halting(spark, config.target.path, 3)
    first = Runner(spark, config, ParquetSource(spark, root), target)
    target.stop = first.cancel.set if how == "cancel" else None
    out = first.run()
    assert out.status == ("cancelled" if how == "cancel" else "failed")
    assert not target.table(ParquetCatalog(spark, root).meta("customer")).exists()
    saved = {r["table_name"]: r["table_status"] for r in first.saved_state().collect()}
    assert saved["customer"] == "failed" and saved.get("region", "completed") == "completed"
    before = target.staged[:]
    whole = FolderTarget(spark, config.target.path)
    seen = []
    again = Halting(spark, config.target.path, 99)
    second = Runner(spark, config, ParquetSource(spark, root), again, progress=seen.append).run(resume=True)
    assert (second.status, second.run_id) == ("completed", out.run_id)
    assert before[0] == 0 and again.staged[0] >= 3
    got = whole.table(ParquetCatalog(spark, root).meta("customer")).read()
    assert rows(got) == sorted(rows_of, key=str)
    assert seen[-1]["rows"] in (len(rows_of), 1)
    # An ended run is not gone on with.
    assert Runner(spark, config, ParquetSource(spark, root), whole).run(resume=True).run_id != out.run_id


def test_progress_is_told_while_a_table_is_copied(spark, folder, tmp_path):
    seen = []
    config = Config(Endpoint(path=folder), Endpoint(path=f"file://{tmp_path}/dst"), Migration(target_mode="drop_recreate"))
    out = Runner(spark, config, ParquetSource(spark, folder), FolderTarget(spark, config.target.path), progress=seen.append, every=0.01).run()
    assert out.status == "completed"
    ticks = [e for e in seen if e["event"] == "progress"]
    assert ticks and all(e["of"] == 2 for e in ticks) and any("nation" in e["active"] for e in ticks)


def test_an_empty_table_is_copied(spark, tmp_path):
    root = f"file://{tmp_path}/src"
    spark.createDataFrame([], "r_regionkey int, r_name string").write.parquet(f"{root}/region.parquet")
    for mode in ("drop_recreate", "upsert"):
        out = _runner(spark, root, tmp_path, mode).run()
        assert (out.status, out.rows_transferred, out.table_errors) == ("completed", 0, [])


def test_cancelled_run_saves_nothing(spark, folder, tmp_path):
    r = _runner(spark, folder, tmp_path, "drop_recreate")
    r.cancel.set()
    out = r.run()
    assert (out.status, out.exit_code(), out.recoverable) == ("cancelled", 5, True)
    assert not r.target.state().exists()


def test_upsert_without_key_is_refused(spark, folder, tmp_path):
    spark.range(2).write.parquet(f"{folder}/bare.parquet")
    out = _runner(spark, folder, tmp_path, "upsert").run()
    assert (out.status, out.exit_code()) == ("failed", 4)
    assert ParquetCatalog(spark, folder).names() == ["bare", "nation", "region"]


def test_jdbc_target(spark, folder, tmp_path):
    db = jdbc.Database("postgres", jdbc_url=f"jdbc:derby:{tmp_path}/target;create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    target = jdbc.JdbcTarget(spark, db, "APP", "postgres", ddl=False)
    config = Config(Endpoint(path=folder), Endpoint(path="x"), Migration())
    seen = []
    out = Runner(spark, config, ParquetSource(spark, folder), target, progress=seen.append).run()
    assert (out.status, out.rows_transferred, len(seen)) == ("completed", 3, 2)
    assert target.table(ParquetCatalog(spark, folder).meta("nation")).read().count() == 2
    jdbc.execute(spark, db, ["CREATE TABLE extra (k INT)", "INSERT INTO extra VALUES (1)"])
    assert jdbc.query(spark, db, "SELECT k FROM extra").count() == 1
    with pytest.raises(Exception):
        jdbc.execute(spark, db, ["INSERT INTO extra VALUES (2)", "nonsense"])
    assert jdbc.query(spark, db, "SELECT k FROM extra").count() == 1


def test_kept_tables_go_with_their_block(spark):
    from tidemark import scratch

    with scratch.cleared(spark):
        one, two = scratch.keep(spark.range(3).toDF("k"), "a"), scratch.keep_by(spark.range(3).toDF("k"), "b", "k")
        assert one.count() == two.count() == 3
        name = scratch._TABLES[-1]
    assert not spark.catalog.tableExists(name)
    with pytest.raises(Exception):
        spark.read.parquet(one._tidemark_path).count()


def test_signed_state(tmp_path):
    path = str(tmp_path / "state.json")
    states.write_signed(path, [{"table_name": "t", "rows": 3}], b"key")
    assert states.read_signed(path, b"key") == [{"table_name": "t", "rows": 3}]
    with pytest.raises(ValueError):
        states.read_signed(path, b"other")


def test_range_counts_cover_the_table_and_empty_ones(spark):
    df = spark.range(-5, 18).selectExpr("id AS k")
    got = partition.range_row_counts(df, "k", partition.equal_width(-5, 17, 4)).collect()
    assert sorted((r["partition_id"], r["row_count"]) for r in got) == [(1, 6), (2, 6), (3, 6), (4, 5)]
    none = partition.range_row_counts(df.limit(0), "k", partition.equal_width(None, None, 4))
    assert none.collect() == [] and none.columns == ["partition_id", "row_count"]


def derby(tmp_path, name="target"):
    return jdbc.Database("postgres", jdbc_url=f"jdbc:derby:{tmp_path}/{name};create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")


def test_a_database_keeps_the_state_of_earlier_runs(spark, folder, tmp_path):
    db = derby(tmp_path)
    runs = []
    for only in ("nation", "region", "nation"):
        config = Config(Endpoint(path=folder), Endpoint(path="x"), Migration(include_tables=[only]))
        target = jdbc.JdbcTarget(spark, db, "APP", "postgres", ddl=False)
        out = Runner(spark, config, ParquetSource(spark, folder), target).run()
        assert (out.status, out.error) == ("completed", None)
        runs.append((out.run_id, only))
        saved = target.state().read()
        assert saved.schema.simpleString() == states.empty(spark).schema.simpleString()
        found = {(r["run_id"], r["table_name"]): r for r in saved.collect()}
        assert set(found) == set(runs) and all(r["run_status"] == "completed" and r["run_completed_at"] for r in found.values())
    marks = {r["table_name"]: r["last_sync_timestamp"] for r in states.last_sync(saved).collect()}
    assert set(marks) == {"nation", "region"}
    # Saving the same rows again changes nothing.
    one = [tuple(r) for r in saved.filter(F.col("run_id") == runs[0][0]).collect()]
    target.state().save(one, "completed", runs[0][0], None)
    assert rows(target.state().read()) == rows(saved)


class Breaking(jdbc.JdbcTarget):
    """Fails at the n-th part: before its transaction, or after it, as a process that dies there."""

    at, after = 99, False

    def ledger(self):
        outer, own = self, super().ledger()
        put = own.put

        def failing(run, table, part, *rest):
            if part == outer.at and not outer.after:
                raise OSError("gone")
            n = put(run, table, part, *rest)
            if part == outer.at:
                raise OSError("gone")
            return n

        own.put = failing
        return own


@pytest.mark.parametrize("after", [False, True])
def test_a_database_gets_each_part_once(spark, tmp_path, after):
    root = f"file://{tmp_path}/src"
    keys = [-(2**62), *range(0, 90), 2**62]
    spark.createDataFrame([(k, f"c{k % 5}", k % 7) for k in keys], "c_custkey long, c_name string, c_nationkey int").repartition(2).write.parquet(f"{root}/customer.parquet")
    spark.createDataFrame([(0, "r")], "r_regionkey int, r_name string").write.parquet(f"{root}/region.parquet")
    config = Config(Endpoint(path=root), Endpoint(path="x"), Migration(chunk_size=10, workers=1))
    db = derby(tmp_path)
    target = Breaking(spark, db, "APP", "postgres", ddl=False)
    target.at, target.after = 4, after
    first = Runner(spark, config, ParquetSource(spark, root), target).run()
    assert first.status == "failed" and first.failed_tables == ["customer"]
    ledger = jdbc.JdbcTarget(spark, db, "APP", "postgres", ddl=False).ledger()
    assert [p["row_count"] is not None for p in ledger.rows(first.run_id, "customer")] == [i < 4 + after for i in range(10)]
    whole = jdbc.JdbcTarget(spark, db, "APP", "postgres", ddl=False)
    second = Runner(spark, config, ParquetSource(spark, root), whole).run(resume=True)
    assert (second.status, second.run_id) == ("completed", first.run_id)
    assert sorted(r["c_custkey"] for r in whole.table(ParquetCatalog(spark, root).meta("customer")).read().collect()) == keys
    assert ledger.rows(first.run_id, "customer") == []
    state = {r["table_name"]: r for r in whole.state().read().collect()}
    assert (state["customer"]["rows_transferred"], state["customer"]["run_status"]) == (len(keys), "completed")
    left = jdbc.query(spark, db, "SELECT TABLENAME AS n FROM SYS.SYSTABLES WHERE TABLENAME LIKE 'part%'")
    assert left.count() == 0


def test_a_resumed_run_checks_the_tables_it_had_finished(spark, folder, tmp_path):
    """The violations are those of a run that never failed."""
    spark.createDataFrame([(1, "n", 0), (1, "again", 0), (2, "m", 5), (3, "k", 6)], "n_nationkey int, n_name string, n_regionkey int").write.mode("overwrite").parquet(f"{folder}/nation.parquet")
    whole = _runner(spark, folder, tmp_path / "whole", "drop_recreate").run()
    assert len(whole.violations) == 2

    class Failing(FolderTarget):
        def table(self, meta):
            if meta.name == "region":
                raise OSError("gone")
            return super().table(meta)

    config = Config(Endpoint(path=folder), Endpoint(path=f"file://{tmp_path}/dst"), Migration(target_mode="drop_recreate"))
    first = Runner(spark, config, ParquetSource(spark, folder), Failing(spark, config.target.path)).run()
    assert (first.status, first.violations) == ("failed", [])
    second = Runner(spark, config, ParquetSource(spark, folder), FolderTarget(spark, config.target.path)).run(resume=True)
    assert (second.status, second.run_id, second.violations) == ("completed", first.run_id, whole.violations)


def test_finalising_twice_is_as_once(spark, tmp_path):
    from tidemark.model import Check, ColumnMeta, ForeignKey, Index, TableMeta

    db = derby(tmp_path)
    jdbc.execute(spark, db, ['CREATE TABLE "p" ("id" INT NOT NULL)', 'CREATE TABLE "c" ("id" INT NOT NULL, "p" INT, "v" INT)'])
    columns = (ColumnMeta("id", "int4", nullable=False),)
    tables = [
        TableMeta("p", columns, ("id",)),
        TableMeta("c", (*columns, ColumnMeta("p", "int4"), ColumnMeta("v", "int4")), ("id",), (ForeignKey("fk_c", ("p",), "p", ("id",)),), (Check("ck_c", "([v] > 0)"),), (Index("ix_c", ("v",)),)),
    ]
    target = jdbc.JdbcTarget(spark, db, "APP", "postgres")
    assert target.finalise(tables) == target.finalise(tables) == []
    key, names = target.made("c")
    assert key and {"fk_c", "ix_c"} <= names


def files_of(table):
    return {f for f in table._folders(table.version()) if not f.startswith("index-")}


@pytest.mark.parametrize("keys", [["k"], ["g", "k"]])
def test_a_merge_rewrites_only_what_it_touches(spark, tmp_path, keys):
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    table.file_rows = 50
    make = lambda ks, v: spark.createDataFrame([(f"g{k // 100}", k, v) for k in ks], "g string, k long, v string")
    table.publish(make(range(1000), "old").repartition(7))
    assert table.index() is None and table.merge(make([3], "first"), keys) == 1
    before = files_of(table)
    assert len(before) >= 15 and sum(r[1] for r in table.index().rows) == 1000
    want = {k: "old" for k in range(1000)} | {3: "first"}
    for ks, most in ((range(410, 420), 2), ([700, 5000, -1], 3), ([6000], 2), ([], 0), (range(0, 1000, 7), 99), (range(300, 306), 2)):
        assert table.merge(make(ks, str(len(ks))), keys) == len(ks)
        want |= {k: str(len(ks)) for k in ks}
        now = files_of(table)
        assert len(before - now) <= most and table.index() is not None
        before = now
        assert {r["k"]: r["v"] for r in table.read().collect()} == want and table.read().count() == len(want)
        assert sum(r[1] for r in table.index().rows) == len(want)
    assert table.merge(make(range(0, 1000, 3), "many"), keys) == 334 and table.index() is None
    assert table.merge(make([3], "again"), keys) == 1 and sum(r[1] for r in table.index().rows) == len(want)
    assert table.holding(spark.createDataFrame([("g4", 415)], "a string, b long"), keys, ["b"] if keys == ["k"] else ["a", "b"]).count() <= 110
    table.publish(make([1], "new"))
    assert rows(table.read()) == [("g0", 1, "new")] and table.index() is None


def test_merges_of_odd_keys(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    table.file_rows = 3
    kind = "k string, v int"
    table.publish(spark.createDataFrame([(None, 0), ("", 1), ("ä", 2), ("\U0001f600", 3), ("z", 4), ("Z", 5), ("￿", 6)], kind))
    for batch in ([("", 10)], [("\U0001f600", 30), ("￿", 60)], [("aa", 70), ("zz", 80)], [(None, 90)]):
        table.merge(spark.createDataFrame(batch, kind), ["k"])
    got = rows(table.read())
    # A null key equals no key, as in SQL.
    assert got == sorted([(None, 0), ("", 10), ("ä", 2), ("\U0001f600", 30), ("z", 4), ("Z", 5), ("￿", 60), ("aa", 70), ("zz", 80), (None, 90)], key=str)


def test_an_upsert_checks_the_rows_it_brought(spark, folder, tmp_path):
    _runner(spark, folder, tmp_path, "drop_recreate").run()
    merged = _runner(spark, folder, tmp_path, "upsert").run()
    assert (merged.status, merged.violations) == ("completed", [{"table": "nation", "constraint": "fk_n_regionkey", "rows": 1}])
    spark.createDataFrame([(9, "new", 0), (9, "twice", 0), (10, "orphan", 77)], "n_nationkey int, n_name string, n_regionkey int").write.mode("overwrite").parquet(f"{folder}/nation.parquet")
    out = _runner(spark, folder, tmp_path, "upsert", exclude_tables=["region"]).run()
    # The parent is in no run of its own here; its table is not among those that are checked.
    assert out.violations == [{"table": "nation", "constraint": "primary key", "rows": 1}]
    out = _runner(spark, folder, tmp_path, "upsert").run()
    assert out.violations == [{"table": "nation", "constraint": "primary key", "rows": 1}, {"table": "nation", "constraint": "fk_n_regionkey", "rows": 1}]


def test_parents_are_read_where_changes_point(spark, tmp_path):
    target = FolderTarget(spark, f"file://{tmp_path}")
    metas = [m for m in (ParquetCatalog(spark, "x").metadata[n] for n in ("customer", "orders"))]
    parent = target.table(metas[0])
    parent.file_rows = 20
    parent.publish(spark.range(1000).selectExpr("id AS c_custkey", "'c' AS c_name"))
    parent.merge(spark.range(1).selectExpr("id AS c_custkey", "'d' AS c_name"), ["c_custkey"])
    assert parent.index() is not None
    changes = spark.createDataFrame([(1, 500), (2, 501), (3, 5000), (4, None)], "o_orderkey long, o_custkey long")
    assert len(parent.holding(changes, ["c_custkey"], ["o_custkey"]).inputFiles()) <= 2 < len(parent.read().inputFiles())
    assert target.check_changes(metas, {"orders": changes}) == [{"table": "orders", "constraint": "fk_o_custkey", "rows": 1}]


def test_kept_tables_go_after_the_session_was_stopped(tmp_path):
    import subprocess
    import sys

    code = f"""
import sys; sys.path.insert(0, {str(sys.path[0])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", "file://{tmp_path}").config("spark.ui.enabled", "false").getOrCreate()
from tidemark import scratch
scratch.keep(spark.range(3).toDF("k"), "a"); b = scratch.keep(spark.range(3).toDF("k"), "b"); scratch.drop(b)
spark.stop()
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, check=True, timeout=120, capture_output=True)
    ours = lambda: [f for f in os.listdir(tmp_path) if f.startswith(("a-", "b-"))]  # noqa: E731  Spark leaves a folder of its own
    for _ in range(50):
        if not ours():
            break
        time.sleep(0.2)
    assert ours() == []


def _in_parts(df, keys, cuts):
    bounds = [None, *cuts, None]
    return [splits.between(df, keys, a, b) for a, b in zip(bounds, bounds[1:], strict=False)]


@pytest.mark.parametrize("keys", [["a"], ["a", "b"], ["t"], ["d", "a"]])
def test_parts_between_cuts_hold_each_row_once(spark, keys):
    data = [(None if i % 17 == 0 else i // 3 - 40, None if i % 11 == 0 else f"b{i % 5}", dt.datetime(2024, 1, 1 + i % 25, i % 7, 0, 0, i), Decimal(i % 9) / 4 if i % 5 else None) for i in range(300)]
    df = spark.createDataFrame(data + data[:40], "a long, b string, t timestamp_ntz, d decimal(9,2)").repartition(4)
    cuts = splits.cut_points(df, keys, 7)
    assert 1 < len(cuts) <= 6
    parts = [rows(p) for p in _in_parts(df, keys, cuts)]
    assert sorted((r for p in parts for r in p), key=str) == rows(df)
    numbered = splits.part_numbers(df, keys, cuts).groupBy("part").count().collect()
    assert sorted((r["part"], r["count"]) for r in numbered) == [(i, len(p)) for i, p in enumerate(parts, 1) if p]


def test_cuts_of_skewed_keys_are_balanced(spark, monkeypatch):
    """Nine keys of ten lie in a hundredth of the range; equal widths would put them in one part."""
    monkeypatch.setattr(splits, "PER_PART", 200)
    n = 40_000
    df = spark.range(n).selectExpr(f"CASE WHEN id % 10 > 0 THEN id ELSE id * 1000 END AS k")
    sizes = [p.count() for p in _in_parts(df, ["k"], splits.cut_points(df, ["k"], 16))]
    assert sum(sizes) == n and len(sizes) == 16 and max(sizes) < 2 * n / 16
    one = spark.range(100).selectExpr("1 AS k")
    assert splits.cut_points(one, ["k"], 5) == [] and splits.cut_points(one.limit(0), ["k"], 5) == []


def test_sql_between_cuts(spark, tmp_path):
    """The text for databases, on Derby; the first part takes nulls."""
    db = derby(tmp_path)
    data = [(i // 4, f"x{i % 4}'", i) for i in range(40)]
    jdbc.write_table(spark.createDataFrame(data, "a int, b string, v int").selectExpr("a", "CAST(b AS varchar(9)) AS b", "v"), db, "t", mode="overwrite", column_types="b VARCHAR(9)")
    cuts = [None, ["2", "x1'"], ["7", "x3'"], None]
    read = jdbc.read_between(spark, db, "t", ["a", "b"], cuts, {"a"})
    assert read.rdd.getNumPartitions() == 3 and rows(read) == sorted(data, key=str)
    assert [r["n"] for r in read.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()] == [10, 22, 8]
    assert splits.sql_between("mysql", ["k"], ["a\\b"], None) == "`k` > 'a\\\\b'"
    assert "ROW_NUMBER() OVER (ORDER BY [a], [b])" in sqltext.cut_points("mssql", "dbo", "t", ["a", "b"], 9)


def test_a_database_is_read_between_balanced_cuts(spark, tmp_path, monkeypatch):
    from tidemark.model import ColumnMeta, TableMeta

    db = derby(tmp_path)
    keys = [*range(900), *range(10**9, 10**9 + 100)]
    jdbc.write_table(spark.createDataFrame([(k, 1) for k in keys], "k long, v int"), db, jdbc.quote("postgres", "t"), mode="overwrite")
    source = JdbcSource(spark, db, "", readers=4)
    meta = TableMeta("t", (ColumnMeta("k", "int8"), ColumnMeta("v", "int4")), ("k",))
    monkeypatch.setattr(JdbcSource, "tasks", lambda self, table: 8)
    sizes = [r["n"] for r in source.read(meta).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 1000 and len(sizes) == 8 and max(sizes) < 250
    parts = source.parts(meta, 300)
    assert len(parts) == 4 and sorted(r["k"] for p in parts for r in source.read_part(meta, p).collect()) == keys
    # Text is cut by the database's own order or not at all.
    text = TableMeta("t", (ColumnMeta("k", "text"),), ("k",))
    assert source.cut_points(text, 4, 1000) == [] and source.parts(meta, 600) == []


def test_parts_of_files(spark, tmp_path):
    root = f"file://{tmp_path}"
    spark.range(100).selectExpr("id AS c_custkey").repartition(10).write.parquet(f"{root}/customer.parquet")
    spark.range(60).selectExpr("id AS x").coalesce(1).write.parquet(f"{root}/bare.parquet")
    source = ParquetSource(spark, root)
    meta = {t.name: t for t in source.tables()}
    parts = source.parts(meta["customer"], 25)
    assert 3 <= len(parts) <= 4 and sorted(f for p in parts for f in p["files"]) == sorted(f for f, _ in source._files(meta["customer"]))
    assert sorted(r[0] for p in parts for r in source.read_part(meta["customer"], p).collect()) == list(range(100))
    assert source.parts(meta["bare"], 10) == [] and source.parts(meta["customer"], 60) == []


def test_rows_rise_while_one_table_is_copied_whole(spark, tmp_path):
    root = f"file://{tmp_path}/src"
    spark.range(400).selectExpr("id AS c_custkey", "'c' AS c_name").repartition(24).write.parquet(f"{root}/customer.parquet")
    wait = F.pandas_udf(lambda s: (time.sleep(0.25), s)[1], "long")

    class Slow(ParquetSource):
        def read(self, table):
            return super().read(table).repartition(24).withColumn("c_custkey", wait("c_custkey"))

    seen = []
    config = Config(Endpoint(path=root), Endpoint(path=f"file://{tmp_path}/dst"), Migration())
    out = Runner(spark, config, Slow(spark, root), FolderTarget(spark, config.target.path), progress=seen.append, every=0.2).run()
    told = [e["rows"] for e in seen if e["event"] == "progress" and e["active"]]
    assert out.rows_transferred == 400 and any(0 < n < 400 for n in told) and told == sorted(told)


def test_cancel_ends_a_long_job_and_leaves_a_run_to_go_on_with(spark, tmp_path):
    root = f"file://{tmp_path}/src"
    spark.range(400).selectExpr("id AS c_custkey", "'c' AS c_name").repartition(40).write.parquet(f"{root}/customer.parquet")
    wait = F.pandas_udf(lambda s: (time.sleep(3), s)[1], "long")

    class Slow(ParquetSource):
        slow = True

        def read_part(self, table, bound):
            df = super().read_part(table, bound)
            return df.repartition(20).withColumn("c_custkey", wait("c_custkey")) if self.slow and started.is_set() else df

    started = threading.Event()
    config = Config(Endpoint(path=root), Endpoint(path=f"file://{tmp_path}/dst"), Migration(chunk_size=100))
    target = FolderTarget(spark, config.target.path)
    runner = Runner(spark, config, Slow(spark, root), target, grace=0.5, progress=lambda e: started.set() if e.get("rows", 0) >= 90 else None, every=0.05)
    stopper = threading.Thread(target=lambda: (started.wait(60), time.sleep(1), runner.cancel.set()))
    stopper.start()
    began = time.monotonic()
    out = runner.run()
    stopper.join()
    assert out.status == "cancelled" and out.exit_code() == 5 and time.monotonic() - began < 25
    done = [p for p in target.ledger().rows(out.run_id, "customer") if p["row_count"]]
    assert done
    again = Slow(spark, root)
    again.slow = False
    second = Runner(spark, config, again, target).run(resume=True)
    assert (second.status, second.run_id, second.rows_transferred) == ("completed", out.run_id, 400)
    assert sorted(r[0] for r in target.table(again.tables()[0]).read().select("c_custkey").collect()) == list(range(400))


def test_what_superseded_runs_left_is_swept(spark, tmp_path):
    root = f"file://{tmp_path}/src"
    spark.range(60).selectExpr("id AS c_custkey").repartition(6).write.parquet(f"{root}/customer.parquet")
    config = Config(Endpoint(path=root), Endpoint(path=f"file://{tmp_path}/dst"), Migration(chunk_size=10))
    target = Halting(spark, config.target.path, 2)
    first = Runner(spark, config, ParquetSource(spark, root), target).run()
    folders = [p["folder"] for p in target.ledger().rows(first.run_id, "customer") if p["folder"]]
    assert first.status == "failed" and len(folders) == 2 and all(os.path.exists(f"{tmp_path}/dst/customer/{f}") for f in folders)
    whole = FolderTarget(spark, config.target.path)
    assert Runner(spark, config, ParquetSource(spark, root), whole).run().status == "completed"
    # The run that failed is no more the last of its settings: the one after it may sweep.
    assert Runner(spark, config, ParquetSource(spark, root), whole).run().status == "completed"
    assert not any(os.path.exists(f"{tmp_path}/dst/customer/{f}") for f in folders) and whole.ledger().runs() == []


def test_rows_that_do_not_fit_go_to_the_rejects(spark, tmp_path):
    root = f"file://{tmp_path}/src"
    data = [(1, "12", "2024-01-01"), (2, "x1", "2024-02-30"), (3, None, None), (4, "70000", "2024-01-02"), (5, "-7", "")]
    spark.createDataFrame(data, "r_regionkey int, size string, day string").write.parquet(f"{root}/region.parquet")
    types = {"size": "smallint", "day": "date"}
    for target in (FolderTarget(spark, f"file://{tmp_path}/dst"), jdbc.JdbcTarget(spark, derby(tmp_path), "APP", "postgres", ddl=False)):
        config = Config(Endpoint(path=root), Endpoint(path="x"), Migration(convert={"region": types}))
        out = Runner(spark, config, ParquetSource(spark, root), target).run()
        assert (out.status, out.rows_transferred) == ("completed", 2)
        kept = target.table(ParquetCatalog(spark, root).meta("region")).read()
        assert sorted(r[0] for r in kept.collect()) == [1, 3] and target.state().read().first()["rows_skipped"] == 3
        bad = target.rejects().read() if isinstance(target, FolderTarget) else jdbc.query(spark, target.db, 'SELECT * FROM "sync_rejects"')
        got = sorted((json.loads(r["row_key"])["r_regionkey"], r["column_name"], r["value"]) for r in bad.collect())
        assert got == [(2, "day", "2024-02-30"), (2, "size", "x1"), (4, "size", "70000"), (5, "day", "")]
    config.migration.reject_limit = 2
    out = Runner(spark, config, ParquetSource(spark, root), FolderTarget(spark, f"file://{tmp_path}/other")).run()
    assert out.status == "failed" and "3 rows do not fit, 2 may" in out.table_errors[0]["message"]
    parts = tolerant.Conversion(spark.createDataFrame(data, "k int, size string, day string"), types, ["k"], nulls=True)
    assert parts.good.count() == 5 and parts.counts() == {"rows": 5, "rejected": 0, "size": 2, "day": 2} and parts.rejects.count() == 4
    assert tolerant.Conversion(spark.createDataFrame([], "k int, size string, day string"), types, ["k"], limit=0).counts()["rows"] == 0


@pytest.mark.parametrize("keys", [["k"], ["g", "k"]])
def test_one_changed_row_compares_one_leaf(spark, tmp_path, keys):
    n, seen = 20_000, []
    spark.range(n).selectExpr("CASE WHEN id % 10 > 0 THEN id ELSE id * 100000 END AS k", "concat('g', id % 3) AS g", "id % 100 AS v").repartitionByRange(8, *keys).sortWithinPartitions(*keys).write.parquet(f"file://{tmp_path}/a")
    source = spark.read.parquet(f"file://{tmp_path}/a")
    target = source.withColumn("v", F.when(F.col("k") == 777, -1).otherwise(F.col("v")))
    cuts = splits.cut_points(source, keys, 200, n)
    a, b = (hashtree.tree(x, keys, ["k", "g", "v"], cuts) for x in (source, target))
    apart = hashtree.differing_leaves(a, b, cuts)
    assert len(apart) == 1 and hashtree.rows_of_leaves(source, keys, cuts, apart).count() < 2 * n / 200
    assert max(r["n"] for r in a.filter("level = 0").collect()) < 2 * n / 200
    assert [r["k"] for r in hashtree.tree_diff(source, target, keys, ["k", "g", "v"], 100).collect()] == [777]
    assert hashtree.tree_diff(source, source, keys, ["k", "g", "v"], 100).count() == 0
    other = target.filter("k <> 5").unionByName(spark.createDataFrame([(-9, "g9", 1)], "k long, g string, v long"))
    got = hashtree.tree_diff(source, other, keys, ["k", "g", "v"], 100, kept=(hashtree.tree(other, keys, ["k", "g", "v"], cuts), cuts))
    assert sorted((r["k"], r["status"]) for r in got.collect()) == [(-9, "extra"), (5, "missing"), (777, "different")]


def test_many_leaves_and_none(spark, monkeypatch):
    df = spark.range(300).selectExpr("id AS k", "id AS v")
    monkeypatch.setattr(hashtree, "SPANS", 3)
    half = df.withColumn("v", F.when(F.col("k") % 20 == 0, -1).otherwise(F.col("v")))
    assert hashtree.tree_diff(df, half, ["k"], ["k", "v"], 10).count() == 15
    assert hashtree.tree_diff(df.limit(0), df.limit(0), ["k"], ["k", "v"], 10).count() == 0
    assert hashtree.tree_diff(df.limit(0), df, ["k"], ["k", "v"], 10).count() == 300
