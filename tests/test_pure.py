"""Functions that need no session."""

import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.functions import idents, tuning, types
from tidemark.operators import constraints, partition, scan
from tidemark.model import ColumnMeta, ForeignKey, TableMeta
from tidemark.plans import config, sqltext

MAPPINGS = [
    ("mssql", "postgres", "bit", 0, 0, 0, "boolean", False),
    ("mssql", "postgres", "nvarchar", -1, 0, 0, "text", False),
    ("mssql", "postgres", "nvarchar", 50, 0, 0, "varchar(50)", False),
    ("mssql", "postgres", "geometry", 0, 0, 0, "text", True),
    ("mssql", "postgres", "strange", 0, 0, 0, "text", True),
    ("mssql", "mysql", "datetimeoffset", 0, 0, 0, "DATETIME", True),
    ("postgres", "mssql", "date", 0, 0, 0, "date", False),
    ("postgres", "mssql", "int4[]", 0, 0, 0, "nvarchar(max)", True),
    ("postgres", "mssql", "numeric", 0, 60, 5, "decimal(38,5)", True),
    ("postgres", "mysql", "varchar", 0, 0, 0, "LONGTEXT", False),
    ("postgres", "mysql", "interval", 0, 0, 0, "VARCHAR(100)", True),
    ("mysql", "postgres", "json", 0, 0, 0, "json", False),
    ("mysql", "postgres", "bit", 8, 0, 0, "bit(8)", False),
    ("mysql", "postgres", "tinyint(1)", 0, 0, 0, "boolean", False),
    ("mysql", "mssql", "tinyint", 4, 0, 0, "smallint", False),
    ("pg", "mariadb", "uuid", 0, 0, 0, "VARCHAR(36)", True),
    ("postgres", "spark", "timestamptz", 0, 0, 0, "timestamp", False),
    ("postgres", "spark", "_int4", 0, 0, 0, "array<int>", False),
    ("mssql", "spark", "decimal", 0, 12, 3, "decimal(12,3)", False),
]


@pytest.mark.parametrize("case", MAPPINGS)
def test_canonical_types(case):
    *args, target, lossy = case
    found = types.map_type(*args)
    assert (found.target, found.lossy) == (target, lossy)
    assert bool(found.warning) == lossy


@pytest.mark.parametrize(
    "args, target",
    [
        (("postgres", "mssql", "date"), "datetime2"),
        (("postgres", "mssql", "numeric"), "decimal(38,10)"),
        (("mysql", "postgres", "json"), "jsonb"),
        (("mysql", "postgres", "bit", 8), "bit varying"),
        (("postgres", "mysql", "serial"), "INT AUTO_INCREMENT"),
        (("mssql", "postgres", "decimal"), "numeric"),
        (("mssql", "postgres", "geometry"), "text"),
    ],
)
def test_direct_types(args, target):
    assert types.map_type(*args, profile="direct").target == target


def test_same_database_keeps_lengths():
    assert types.map_type("mssql", "mssql", "nvarchar", 50).target == "nvarchar(50)"
    assert types.map_type("mysql", "mysql", "double").target == "double"


@pytest.mark.parametrize("kind", types.KINDS)
def test_every_kind_has_a_form_everywhere(kind):
    c = types.Canonical(kind, 5, 2, types.Canonical("Int32") if kind == "Array" else None)
    assert all(types.from_canonical(t, c).target for t in (*types.DIALECTS, "spark"))


@pytest.mark.parametrize("name", ["", "a\0b", "x" * 129])
def test_bad_identifiers(name):
    with pytest.raises(idents.UnsafeText):
        idents.quote("postgres", name)


def test_quoting():
    assert idents.quote("mssql", "a]b") == "[a]]b]"
    assert idents.quote("postgres", 'a"b') == '"a""b"'
    assert idents.quote("mysql", "a`b") == "`a``b`"
    assert idents.quote("spark", "x" * 128) == "`" + "x" * 128 + "`"


@pytest.mark.parametrize("text", ["1=1; DROP TABLE t", "a > 0 -- b", "a /* b", "a */ b", "1=1 EXEC x", "execute(x)", "xp_cmdshell('x')", "x = SP_OACREATE"])
def test_unsafe_checks(text):
    with pytest.raises(idents.UnsafeText):
        idents.validate_check(text)


@pytest.mark.parametrize("text", ["a > 0", "status IN ('a', 'b')", "sp_rate > 1", "xp_value < 2", "executed = 1", "my_exec_count > 0"])
def test_safe_checks(text):
    assert idents.validate_check(text) == text


def test_check_translation():
    assert idents.translate_check("([a] > getdate())", "postgres") == '("a" > CURRENT_TIMESTAMP)'
    assert idents.translate_check('([a] > GETDATE() AND "b" > 1)', "mysql") == "(`a` > NOW() AND `b` > 1)"


def test_referential_actions():
    assert idents.referential_action("SET_NULL") == "SET NULL"
    assert idents.referential_action("restrict") == "RESTRICT"
    assert idents.referential_action("restrict", "postgres") == "NO ACTION"
    assert idents.referential_action("whatever") == "NO ACTION"


@given(st.integers(-(2**63), 2**63 - 1), st.integers(0, 10**6), st.integers(1, 40))
def test_ranges_cover_once(low, width, parts):
    ranges = partition.equal_width(low, low + width, parts)
    assert ranges[0][0] == low and ranges[-1][1] == low + width + 1
    assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    assert max(b - a for a, b in ranges) - min(b - a for a, b in ranges) <= 1


def test_predicates_are_open_at_both_ends():
    assert partition.predicates("k", [(-5, 0), (0, 5), (5, 9)]) == ["(k < 0 OR k IS NULL)", "k >= 0 AND k < 5", "k >= 5"]
    assert partition.predicates("k", []) == ["1 = 1"]


def test_partition_count():
    assert partition.partition_count(10, 200_000, 4, 5_000_000) == 1
    assert partition.partition_count(6_000_000, 200_000, 4, 5_000_000) == 4


def test_watermarks():
    now = dt.datetime(2024, 1, 1)
    scan.check_watermark(now + dt.timedelta(minutes=59), now)
    for bad in (now + dt.timedelta(hours=2), now - dt.timedelta(days=36_501)):
        with pytest.raises(scan.WatermarkError):
            scan.check_watermark(bad, now)


def _table(name, *parents):
    return TableMeta(name, foreign_keys=tuple(ForeignKey(f"f{p}", ("a",), p, ("a",)) for p in parents))


def test_levels():
    assert constraints.fk_levels([_table("c", "b"), _table("b", "a"), _table("a", "a", "outside")]) == [["a"], ["b"], ["c"]]
    assert constraints.fk_levels([_table("x", "y"), _table("y", "x"), _table("z")]) == [["z"], ["x", "y"]]
    assert constraints.fk_levels([]) == []


def test_globs():
    assert config.keeps("dbo.Users", [], [])
    assert config.keeps("dbo.Users", ["user?"], [])
    assert not config.keeps("dbo.Users", ["user*"], ["USERS"])
    assert not config.keeps("dbo.Users", ["dbo*"], [])


YAML = """
source: {type: sqlserver, host: a, database: d, user: u, password: p}
target: {type: pg, host: b, database: d, user: u}
migration: {target_mode: upsert, parallel_writers: 3}
"""


def test_config():
    c = config.validate(config.parse(YAML, "yaml"))
    assert (c.source.kind(), c.target.kind(), c.migration.write_ahead_writers) == ("mssql", "postgres", 3)
    d = config.parse(YAML.replace("password: p", "password: q"), "yaml")
    assert c.fingerprint() == d.fingerprint() != config.parse(YAML.replace("host: a", "host: z"), "yaml").fingerprint()
    with pytest.warns(UserWarning):
        config.parse(YAML.replace("parallel_writers", "max_partitions"), "yaml")


@pytest.mark.parametrize("old, new", [("host: a", "host: ''"), ("type: pg", "type: oracle"), ("parallel_writers: 3", "workers: 0"), ("parallel_writers: 3", "include_tables: ['a;b']"), ("upsert", "merge"), ("database: d, user: u, password: p", "user: u")])
def test_bad_config(old, new):
    with pytest.raises(config.ConfigError):
        config.validate(config.parse(YAML.replace(old, new, 1), "yaml"))


def test_same_place_is_refused():
    with pytest.raises(config.ConfigError):
        config.validate(config.parse(YAML.replace("host: b", "host: a").replace("type: pg", "type: mssql"), "yaml"))


def test_tuning():
    assert [tuning.workers(c) for c in (2, 16, 64)] == [4, 8, 16]
    assert [tuning.readers(c) for c in (2, 16, 128)] == [2, 4, 16]
    assert tuning.writers(64, "mssql") == 2
    assert tuning.large_table(36) == 4_000_000
    assert tuning.chunk_rows("upsert", 36, 80_000) == 50_000
    assert tuning.chunk_rows("bulk", 36, 120_000) == 120_000
    assert tuning.chunk_cap(10**9, 500, 8, 4) == 31_250
    assert tuning.fallback_batch_rows(3) == 700 and tuning.fallback_batch_rows(5000) == 1
    assert tuning.mean_row_bytes([]) == 500


def test_sql_text():
    assert sqltext.select("mssql", "dbo", "t", ["a"], after="5", key="a", limit=10) == "SELECT TOP (10) [a] FROM [dbo].[t] WITH (NOLOCK) WHERE [a] > 5 ORDER BY [a]"
    assert sqltext.select("postgres", "s", "t", ["a"], upto="9", key="a", where="b = 1", limit=3, offset=2) == 'SELECT "a" FROM "s"."t" WHERE "a" <= 9 AND (b = 1) ORDER BY "a" LIMIT 3 OFFSET 2'
    assert sqltext.merge("postgres", "s", "t", "st", ["a"], ["a"]).endswith('ON CONFLICT ("a") DO NOTHING')
    assert "ON DUPLICATE KEY UPDATE `b` = VALUES(`b`)" in sqltext.merge("mysql", "s", "t", "st", ["a", "b"], ["a"])
    assert "WHEN MATCHED AND (t.[b] <> s.[b]" in sqltext.merge("mssql", "s", "t", "st", ["a", "b"], ["a"])
    assert sqltext.reset_sequence("mysql", "s", "t", "a", 9) == "ALTER TABLE `s`.`t` AUTO_INCREMENT = 10"
    assert sqltext.reset_sequence("mssql", "s", "t", "a", 9) is None


def test_spatial_columns_are_read_as_text():
    t = TableMeta("t", (ColumnMeta("id", "int"), ColumnMeta("g", "geometry")))
    assert sqltext.as_text("mssql", "[s].[t]", t) == "SELECT [id], [g].STAsText() AS [g] FROM [s].[t]"
    assert sqltext.as_text("postgres", "t", t) == 'SELECT "id", ST_AsText("g") AS "g" FROM t'
    assert not sqltext.spatial(t.columns[0])
