"""Databases through JDBC: partitioned reads, batched writes and connection tests."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.idents import qualified, quote
from tidemark.functions.tuning import fallback_batch_rows, mysql_batch_rows
from tidemark.model import TableMeta
from tidemark.operators import splits
from tidemark.operators.partition import equal_width, predicates
from tidemark.sources.files import counting

# URL form, driver class and default port.
_KINDS = {
    "mssql": ("jdbc:sqlserver://{host}:{port};databaseName={database}", "com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433),
    "postgres": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver", 5432),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver", 3306),
}


@dataclass(frozen=True)
class Database:
    kind: str
    host: str = "localhost"
    database: str = ""
    port: int = 0
    user: str = ""
    password: str = ""
    tls: str = "prefer"
    jdbc_url: str = ""
    driver: str = ""

    def url(self) -> str:
        if self.jdbc_url:
            return self.jdbc_url
        form, _, port = _KINDS[self.kind]
        url = form.format(host=self.host, port=self.port or port, database=self.database)
        secure = self.tls in ("require", "verify-ca", "verify-full")
        if self.kind == "mssql":
            return f"{url};encrypt={'true' if secure else 'false'};trustServerCertificate={'false' if self.tls.startswith('verify') else 'true'}"
        if self.kind == "postgres":
            return f"{url}?sslmode={self.tls}"
        return f"{url}?sslMode={ {'disable': 'DISABLED', 'prefer': 'PREFERRED', 'require': 'REQUIRED', 'verify-ca': 'VERIFY_CA', 'verify-full': 'VERIFY_IDENTITY'}[self.tls] }"

    def properties(self) -> dict[str, str]:
        driver = self.driver or _KINDS[self.kind][1]
        return {k: v for k, v in {"driver": driver, "user": self.user, "password": self.password}.items() if v}


def readable(db: Database, schema: str, table: TableMeta) -> str:
    """What to read of a table: its name, or a query that gives spatial columns as WKT text."""
    from tidemark.plans import sqltext

    name = qualified(db.kind, schema, table.name)
    return f"({sqltext.as_text(db.kind, name, table)}) AS t" if any(sqltext.spatial(c) for c in table.columns) else name


def read_table(spark: SparkSession, db: Database, table: str, key: str | None = None, parts: int = 1, fetch: int = 10_000) -> DataFrame:
    """The table in half-open key ranges, one task each; without an integer key in one."""
    options = db.properties() | {"fetchsize": str(fetch)}
    whole = spark.read.jdbc(db.url(), table, properties=options)
    if key is None or parts < 2:
        return whole
    low, high = whole.selectExpr(f"min({key})", f"max({key})").first()
    ranges = equal_width(low, high, parts)
    return spark.read.jdbc(db.url(), table, predicates=predicates(key, ranges), properties=options) if ranges else whole


def read_between(spark: SparkSession, db: Database, table: str, keys: list[str], cuts: list, numbers: set[str], fetch: int = 10_000) -> DataFrame:
    """The rows after the first and up to the last of these cut points (null: open), one task for each pair of neighbours."""
    tests = [splits.sql_between(db.kind, keys, a, b, numbers) for a, b in zip(cuts, cuts[1:], strict=False)]
    return spark.read.jdbc(db.url(), table, predicates=tests, properties=db.properties() | {"fetchsize": str(fetch)})


def query(spark: SparkSession, db: Database, sql: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").option("url", db.url()).options(**db.properties(), **options).option("query", sql).load()


def present(spark: SparkSession, db: Database, name: str) -> bool:
    """Whether a table can be read."""
    try:
        spark.read.jdbc(db.url(), name, properties=db.properties()).schema
    except Exception:  # each driver has its own way to say no
        return False
    return True


def write_table(df: DataFrame, db: Database, table: str, mode: str = "append", column_types: str | None = None, connections: int = 8, rows: int | None = None) -> None:
    """Append or replace; at most ``connections`` tasks write at once, in batches the database takes."""
    width = len(df.columns)
    rows = rows or {"mssql": fallback_batch_rows(width), "mysql": mysql_batch_rows(width)}.get(db.kind, 10_000)
    writer = df.write.mode(mode).format("jdbc").option("url", db.url()).options(**db.properties()).option("dbtable", table)
    writer = writer.option("batchsize", rows).option("numPartitions", connections)
    if column_types:
        writer = writer.option("createTableColumnTypes", column_types)
    writer.save()


def check(spark: SparkSession, db: Database, probe: str = "SELECT 1 AS one") -> tuple[bool, float, str | None]:
    """Whether the database answers, in how many milliseconds, and else why not."""
    began = time.monotonic()
    try:
        query(spark, db, probe).collect()
    except Exception as e:  # what a driver throws is its own
        return False, (time.monotonic() - began) * 1000, str(e).splitlines()[0]
    return True, (time.monotonic() - began) * 1000, None


# Catalog queries of the base tables of a schema; each database's give the same columns.
_COLUMNS = (
    "SELECT c.table_name, c.column_name, {kind} AS data_type, c.character_maximum_length, c.numeric_precision, c.numeric_scale, c.is_nullable, c.ordinal_position, {identity} AS is_identity"
    " FROM information_schema.columns c JOIN information_schema.tables t ON t.table_schema = c.table_schema AND t.table_name = c.table_name"
    " WHERE t.table_type = 'BASE TABLE' AND c.table_schema = {schema}"
)
_KEYS = (
    "SELECT k.table_name, k.column_name, k.ordinal_position FROM information_schema.table_constraints t JOIN information_schema.key_column_usage k"
    " ON k.constraint_name = t.constraint_name AND k.table_schema = t.table_schema AND k.table_name = t.table_name WHERE t.constraint_type = 'PRIMARY KEY' AND t.table_schema = {schema}"
)
_CHECKS = (
    "SELECT t.table_name, c.constraint_name AS name, c.check_clause AS definition FROM information_schema.check_constraints c JOIN information_schema.table_constraints t"
    " ON t.constraint_schema = c.constraint_schema AND t.constraint_name = c.constraint_name WHERE t.table_schema = {schema} AND c.check_clause NOT LIKE '%IS NOT NULL'"
)
_ACTION = "CASE c.{} WHEN 'c' THEN 'CASCADE' WHEN 'n' THEN 'SET NULL' WHEN 'd' THEN 'SET DEFAULT' WHEN 'r' THEN 'RESTRICT' ELSE 'NO ACTION' END"
_CATALOG = {
    "postgres": {
        "columns": _COLUMNS.replace("{kind}", "CASE WHEN c.data_type IN ('ARRAY', 'USER-DEFINED') THEN c.udt_name ELSE c.data_type END").replace(
            "{identity}", "CASE WHEN c.is_identity = 'YES' OR c.column_default LIKE 'nextval(%' THEN 1 ELSE 0 END"
        ),
        "keys": _KEYS,
        "rows": "SELECT c.relname AS table_name, CAST(c.reltuples AS bigint) AS n FROM pg_class c JOIN pg_namespace s ON s.oid = c.relnamespace WHERE c.relkind = 'r' AND s.nspname = {schema}",
        "references": (
            f"SELECT t.relname AS table_name, c.conname AS name, k.place AS ordinal_position, a.attname AS column_name, p.relname AS parent, b.attname AS parent_column, {_ACTION.format('confdeltype')} AS on_delete, {_ACTION.format('confupdtype')} AS on_update"
            " FROM pg_constraint c JOIN pg_class t ON t.oid = c.conrelid JOIN pg_namespace s ON s.oid = t.relnamespace JOIN pg_class p ON p.oid = c.confrelid"
            " CROSS JOIN LATERAL unnest(c.conkey, c.confkey) WITH ORDINALITY AS k(own, other, place)"
            " JOIN pg_attribute a ON a.attrelid = c.conrelid AND a.attnum = k.own JOIN pg_attribute b ON b.attrelid = c.confrelid AND b.attnum = k.other"
            " WHERE c.contype = 'f' AND s.nspname = {schema}"
        ),
        "checks": (
            "SELECT t.relname AS table_name, c.conname AS name, pg_get_expr(c.conbin, c.conrelid) AS definition FROM pg_constraint c JOIN pg_class t ON t.oid = c.conrelid"
            " JOIN pg_namespace s ON s.oid = t.relnamespace WHERE c.contype = 'c' AND s.nspname = {schema}"
        ),
        "indexes": (
            "SELECT t.relname AS table_name, i.relname AS name, CASE WHEN x.indisunique THEN 1 ELSE 0 END AS is_unique, k.place AS ordinal_position, a.attname AS column_name, CASE WHEN k.place > x.indnkeyatts THEN 1 ELSE 0 END AS is_included"
            " FROM pg_index x JOIN pg_class t ON t.oid = x.indrelid JOIN pg_class i ON i.oid = x.indexrelid JOIN pg_namespace s ON s.oid = t.relnamespace CROSS JOIN LATERAL unnest(x.indkey) WITH ORDINALITY AS k(number, place)"
            " JOIN pg_attribute a ON a.attrelid = t.oid AND a.attnum = k.number WHERE NOT x.indisprimary AND x.indpred IS NULL AND s.nspname = {schema}"
        ),
    },
    "mysql": {
        "columns": _COLUMNS.replace("{kind}", "CASE WHEN c.data_type = 'tinyint' OR c.column_type LIKE '%unsigned' THEN c.column_type ELSE c.data_type END").replace("{identity}", "CASE WHEN c.extra LIKE '%auto_increment%' THEN 1 ELSE 0 END"),
        "keys": _KEYS,
        "references": (
            "SELECT k.table_name, r.constraint_name AS name, k.ordinal_position, k.column_name, k.referenced_table_name AS parent, k.referenced_column_name AS parent_column, r.delete_rule AS on_delete, r.update_rule AS on_update"
            " FROM information_schema.referential_constraints r JOIN information_schema.key_column_usage k ON k.constraint_schema = r.constraint_schema AND k.constraint_name = r.constraint_name AND k.table_name = r.table_name"
            " WHERE k.table_schema = {schema}"
        ),
        "checks": _CHECKS,
        "indexes": (
            "SELECT s.table_name, s.index_name AS name, 1 - s.non_unique AS is_unique, s.seq_in_index AS ordinal_position, s.column_name, 0 AS is_included"
            " FROM information_schema.statistics s WHERE s.index_name <> 'PRIMARY' AND s.table_schema = {schema}"
        ),
    },
    "mssql": {
        "columns": _COLUMNS.replace("{kind}", "c.data_type").replace("{identity}", "COLUMNPROPERTY(OBJECT_ID(QUOTENAME(c.table_schema) + '.' + QUOTENAME(c.table_name)), c.column_name, 'IsIdentity')"),
        "keys": _KEYS,
        "rows": "SELECT OBJECT_NAME(p.object_id) AS table_name, SUM(p.rows) AS n FROM sys.partitions p WHERE p.index_id IN (0, 1) AND OBJECT_SCHEMA_NAME(p.object_id) = {schema} GROUP BY p.object_id",
        "references": (
            "SELECT OBJECT_NAME(f.parent_object_id) AS table_name, f.name, c.constraint_column_id AS ordinal_position, COL_NAME(c.parent_object_id, c.parent_column_id) AS column_name, OBJECT_NAME(f.referenced_object_id) AS parent,"
            " COL_NAME(c.referenced_object_id, c.referenced_column_id) AS parent_column, f.delete_referential_action_desc AS on_delete, f.update_referential_action_desc AS on_update"
            " FROM sys.foreign_keys f JOIN sys.foreign_key_columns c ON c.constraint_object_id = f.object_id WHERE OBJECT_SCHEMA_NAME(f.parent_object_id) = {schema}"
        ),
        "checks": "SELECT OBJECT_NAME(c.parent_object_id) AS table_name, c.name, c.definition FROM sys.check_constraints c WHERE OBJECT_SCHEMA_NAME(c.parent_object_id) = {schema}",
        "indexes": (
            "SELECT OBJECT_NAME(i.object_id) AS table_name, i.name, CAST(i.is_unique AS int) AS is_unique, c.index_column_id AS ordinal_position, COL_NAME(c.object_id, c.column_id) AS column_name, CAST(c.is_included_column AS int) AS is_included"
            " FROM sys.indexes i JOIN sys.index_columns c ON c.object_id = i.object_id AND c.index_id = i.index_id WHERE i.type > 0 AND i.is_primary_key = 0 AND i.has_filter = 0 AND OBJECT_SCHEMA_NAME(i.object_id) = {schema}"
        ),
    },
}
#: Columns of each part of a catalog.
_PARTS = {
    "columns": "table_name string, column_name string, data_type string, character_maximum_length long, numeric_precision int, numeric_scale int, is_nullable string, ordinal_position int, is_identity int",
    "keys": "table_name string, column_name string, ordinal_position int",
    "rows": "table_name string, n long",
    "references": "table_name string, name string, ordinal_position int, column_name string, parent string, parent_column string, on_delete string, on_update string",
    "checks": "table_name string, name string, definition string",
    "indexes": "table_name string, name string, is_unique int, ordinal_position int, column_name string, is_included int",
}


def load_catalog(spark: SparkSession, db: Database, schema: str) -> list[TableMeta]:
    """Base tables of a schema with columns, keys, references, checks, indexes and their approximate rows."""
    from tidemark.functions.idents import literal

    parts = {}
    for name, kind in _PARTS.items():
        sql = _CATALOG[db.kind].get(name)
        found = query(spark, db, sql.format(schema=literal(schema))) if sql else spark.createDataFrame([], kind)
        parts[name] = found.toDF(*[c.lower() for c in found.columns])
    return assemble(parts, schema)


def assemble(parts: dict[str, DataFrame], schema: str) -> list[TableMeta]:
    """Metadata of each table out of a catalog's parts: ordered lists by table, joined to the tables' columns."""
    from pyspark.sql import functions as F

    from tidemark.model import Check, ColumnMeta, ForeignKey, Index

    def lists(part: str, by: list[str], *columns: str) -> DataFrame:
        return parts[part].groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ordinal_position", *columns))).alias("x"))

    def of_table(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != "table_name"]))).alias(name))

    whole = lists("columns", ["table_name"], *[c for c in parts["columns"].columns if c not in ("table_name", "ordinal_position")]).withColumnRenamed("x", "columns")
    whole = whole.join(lists("keys", ["table_name"], "column_name").withColumnRenamed("x", "key"), "table_name", "left")
    whole = whole.join(of_table(lists("references", ["table_name", "name", "parent", "on_delete", "on_update"], "column_name", "parent_column"), "references"), "table_name", "left")
    whole = whole.join(of_table(lists("indexes", ["table_name", "name", "is_unique"], "column_name", "is_included"), "indexes"), "table_name", "left")
    whole = whole.join(of_table(parts["checks"].select("table_name", "name", "definition"), "checks"), "table_name", "left")
    whole = whole.join(parts["rows"].groupBy("table_name").agg(F.max("n").alias("n")), "table_name", "left")
    out = []
    for r in whole.orderBy("table_name").collect():
        columns = tuple(
            ColumnMeta(c["column_name"], c["data_type"], int(c["character_maximum_length"] or 0), int(c["numeric_precision"] or 0), int(c["numeric_scale"] or 0), str(c["is_nullable"]).upper() == "YES", bool(c["is_identity"]))
            for c in r["columns"]
        )
        references = tuple(
            ForeignKey(f["name"], tuple(x["column_name"] for x in f["x"]), f["parent"], tuple(x["parent_column"] for x in f["x"]), f["on_delete"].replace("_", " "), f["on_update"].replace("_", " ")) for f in r["references"] or ()
        )
        indexes = tuple(
            Index(i["name"], tuple(x["column_name"] for x in i["x"] if not x["is_included"]), bool(i["is_unique"]), tuple(x["column_name"] for x in i["x"] if x["is_included"])) for i in r["indexes"] or ()
        )
        checks = tuple(Check(c["name"], c["definition"]) for c in r["checks"] or ())
        out.append(TableMeta(r["table_name"], columns, tuple(x["column_name"] for x in r["key"] or ()), references, checks, indexes, max(0, int(r["n"] or 0)), schema))
    return out


def name_in(db: Database, schema: str, table: str) -> str:
    return qualified(db.kind, schema, table)


# SQL states and vendor codes of a deadlock, and of a name that is taken.
_DEADLOCK = {"40001", "40P01"}, {1205, 1213}
_TAKEN = {"42710", "42P07", "X0Y32"}, {2714, 1061, 1826, 3822}


def deadlocked(error) -> bool:
    """Whether what a driver threw, or its cause, says that a deadlock ended the transaction."""
    return _says(error, _DEADLOCK)


def _says(error, codes: tuple[set[str], set[int]]) -> bool:
    e = getattr(error, "java_exception", None)
    while e is not None:
        state, code = getattr(e, "getSQLState", None), getattr(e, "getErrorCode", None)
        if state is not None and code is not None:
            try:
                return state() in codes[0] or code() in codes[1]
            except Exception:  # not an SQL exception
                pass
        e = e.getCause()
    return False


def said(error: Exception) -> str:
    """First line of what the database said."""
    inner = getattr(error, "java_exception", None)
    return (str(inner.getMessage() if inner is not None else error).splitlines() or [type(error).__name__])[0]


def retried(work, wait: float = 0.2, times: int = 5) -> None:
    """``work()``, again after a deadlock, each time after twice the wait."""
    for turn in range(times):
        try:
            return work()
        except Exception as e:
            if turn + 1 == times or not deadlocked(e):
                raise
            time.sleep(wait * 2**turn)


def execute(spark: SparkSession, db: Database, statements: list) -> None:
    """Statements in one connection and one transaction (as far as the database rolls back its DDL); deadlocks are retried.

    A statement is text, or text and its parameters: pairs of a value and its kind (text, int, long or time).
    """
    retried(lambda: _execute(spark, db, statements))


def connect(spark: SparkSession, db: Database):
    jvm = spark._jvm
    properties = jvm.java.util.Properties()
    for k, v in db.properties().items():
        properties.setProperty(k, v)
    # Spark's registry finds drivers that were added to the session later.
    jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(db.properties()["driver"])
    return jvm.java.sql.DriverManager.getConnection(db.url(), properties)


def _bind(jvm, statement, place: int, value, kind: str) -> None:
    types = jvm.java.sql.Types
    if value is None:
        statement.setNull(place, {"text": types.VARCHAR, "int": types.INTEGER, "long": types.BIGINT, "time": types.TIMESTAMP}[kind])
    elif kind == "time":
        statement.setTimestamp(place, jvm.java.sql.Timestamp.valueOf(value.isoformat(sep=" ")))
    else:
        {"text": statement.setString, "int": statement.setInt, "long": statement.setLong}[kind](place, value)


def _execute(spark: SparkSession, db: Database, statements: list) -> None:
    connection = connect(spark, db)
    try:
        connection.setAutoCommit(False)
        plain = connection.createStatement()
        for sql in statements:
            if isinstance(sql, str):
                plain.execute(sql)
                continue
            text, values = sql
            prepared = connection.prepareStatement(text)
            for i, (value, kind) in enumerate(values, 1):
                _bind(spark._jvm, prepared, i, value, kind)
            prepared.executeUpdate()
            prepared.close()
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


class JdbcTable:
    """A table of a target database: replaced whole, or merged through a staging table."""

    def __init__(self, spark: SparkSession, db: Database, schema: str, meta: TableMeta, source_kind: str, ddl: bool = True):
        self.spark, self.db, self.schema, self.meta, self.source_kind, self.ddl = spark, db, schema, meta, source_kind, ddl
        self.name = qualified(db.kind, schema, meta.name) if ddl else meta.name

    def exists(self) -> bool:
        return present(self.spark, self.db, self.name)

    def read(self) -> DataFrame:
        return self.spark.read.jdbc(self.db.url(), self.name, properties=self.db.properties())

    def has_primary_key(self) -> bool:
        from tidemark.functions.idents import literal

        keys = query(self.spark, self.db, _CATALOG[self.db.kind]["keys"].format(schema=literal(self.schema)))
        keys = keys.toDF(*[c.lower() for c in keys.columns])
        return not keys.filter(keys.table_name == self.meta.name).isEmpty()

    def publish(self, df: DataFrame) -> int:
        """Replace the table; the number of rows there, which the database counts."""
        from tidemark.functions.convert import sink_ready

        ready = sink_ready(df, self.db.kind)
        if not (self.ddl and self.meta.columns):
            write_table(ready, self.db, self.name, mode="overwrite")
            return self.count(self.name)
        self.create()
        self._load(ready, self.name)
        self.loaded()
        return self.count(self.name)

    def count(self, name: str) -> int:
        return int(query(self.spark, self.db, f"SELECT COUNT(*) AS n FROM {name}").first()[0])

    def create(self) -> None:
        """The table without rows, keys and indexes; PostgreSQL fills it unlogged. Without DDL Spark makes it with its first rows."""
        from tidemark.plans import sqltext

        if not (self.ddl and self.meta.columns):
            if self.exists():
                execute(self.spark, self.db, [f"DROP TABLE {self.name}"])
            return
        create = sqltext.create_table(self.source_kind, self.db.kind, self.meta, self.schema, unlogged=self.db.kind == "postgres")
        made = [sqltext.create_schema(self.db.kind, self.schema)] if self.schema else []
        execute(self.spark, self.db, [*made, sqltext.drop_table(self.db.kind, self.schema, self.meta.name), create])

    def _load(self, ready: DataFrame, name: str, kept: bool = False) -> None:
        """Append rows that the sink can take. SQL Server gets rows with oversized texts one by one: both kinds of
        rows come from one read of the source, which is kept, so a source that changes meanwhile cannot give a row to both or none."""
        from tidemark.functions.convert import route_oversized
        from tidemark.scratch import drop, keep

        if self.db.kind != "mssql" or not any(f.dataType.simpleString() == "string" for f in ready.schema.fields):
            return write_table(ready, self.db, name)
        once = ready if kept else keep(ready, "routed")
        usual, large = route_oversized(once)
        write_table(usual, self.db, name)
        write_table(large, self.db, name, rows=1)
        if not kept:
            drop(once)

    def loaded(self) -> None:
        from tidemark.plans import sqltext

        if self.ddl and (logged := sqltext.set_logged(self.db.kind, self.schema, self.meta.name, True)):
            execute(self.spark, self.db, [logged])

    def fill_stage(self, stage: str, df: DataFrame) -> int:
        """Write rows to a new table beside; their number, which must be that of the rows there: a task that ran twice may
        have left its rows twice, and then all are written again. The source is read once, into a kept table."""
        from tidemark.functions.convert import sink_ready
        from tidemark.plans import sqltext
        from tidemark.scratch import drop, keep

        name = quote(self.db.kind, stage)
        ready, counted = counting(sink_ready(df, self.db.kind))
        kept = keep(ready, "part")
        rows = counted()
        try:
            for _ in range(2):
                if present(self.spark, self.db, name):
                    self.drop_stage(stage)
                if self.ddl and self.meta.columns:
                    execute(self.spark, self.db, [sqltext.create_staging(self.db.kind, name, kept)])
                    self._load(kept, name, kept=True)
                else:
                    write_table(kept, self.db, name, mode="overwrite")
                if self.count(name) == rows:
                    return rows
        finally:
            drop(kept)
        raise OSError(f"{stage} does not hold the rows that were written to it")

    def move_stage(self, stage: str, columns: list[str]) -> str:
        """The statement that takes the staged rows over; without DDL the first stage also tells what the table is like."""
        if not (self.ddl and self.meta.columns) and not self.exists():
            like = self.spark.read.jdbc(self.db.url(), quote(self.db.kind, stage), properties=self.db.properties())
            write_table(like.limit(0), self.db, self.name, mode="overwrite")
        names = ", ".join(quote(self.db.kind, c) for c in columns)
        return f"INSERT INTO {self.name} ({names}) SELECT {names} FROM {quote(self.db.kind, stage)}"

    def drop_stage(self, stage: str) -> None:
        execute(self.spark, self.db, [f"DROP TABLE {quote(self.db.kind, stage)}"])

    def merge(self, changes: DataFrame, keys: list[str]) -> int:
        """Stage the changes under a name of their own, then merge them and drop the stage; the number of changes.

        The source is read once; the stage takes oversized texts as a load does, and holds each change once, or nothing is merged. The
        merge is one transaction; where the database commits before DDL (MySQL), the drop is not part of it.
        """
        from tidemark.plans import sqltext

        stage = f"stage_{uuid.uuid4().hex[:12]}_{self.meta.name}"[:60]
        try:
            rows = self.fill_stage(stage, changes)
            execute(self.spark, self.db, [sqltext.merge(self.db.kind, self.schema, self.meta.name, stage, changes.columns, keys)])
        finally:
            if present(self.spark, self.db, quote(self.db.kind, stage)):
                self.drop_stage(stage)
        return rows


class JdbcTarget:
    """Tables and state of a target database; keys, indexes, references and checks are made after the load."""

    def __init__(self, spark: SparkSession, db: Database, schema: str, source_kind: str, ddl: bool = True):
        self.spark, self.db, self.schema, self.source_kind, self.ddl = spark, db, schema, source_kind, ddl

    def table(self, meta: TableMeta) -> JdbcTable:
        return JdbcTable(self.spark, self.db, self.schema, meta, self.source_kind, self.ddl)

    def state(self):
        from tidemark.sources.ledger import JdbcState

        return JdbcState(self.spark, self.db)

    def ledger(self):
        from tidemark.sources.ledger import JdbcLedger

        return JdbcLedger(self.spark, self.db)

    def reject(self, rows: DataFrame) -> None:
        """Append values that did not fit to the table sync_rejects."""
        write_table(rows, self.db, quote(self.db.kind, "sync_rejects"))

    def discard(self, parts: list[tuple[str, str]]) -> None:
        """Nothing lies beside the tables."""

    def made(self, table: str) -> tuple[bool, set[str]]:
        """Whether the table has a primary key, and names of its indexes and references, as the driver tells."""
        connection = connect(self.spark, self.db)
        try:
            data, at = connection.getMetaData(), (self.schema if self.db.kind == "mysql" else None, None if self.db.kind == "mysql" else self.schema or None)

            def names(found, column: str) -> set[str]:
                out = set()
                while found.next():
                    out.add(str(found.getString(column)).lower())
                return out

            keys = names(data.getPrimaryKeys(*at, table), "COLUMN_NAME")
            return bool(keys), names(data.getIndexInfo(*at, table, False, True), "INDEX_NAME") | names(data.getImportedKeys(*at, table), "FK_NAME")
        finally:
            connection.close()

    def finalise(self, tables: list[TableMeta], references: bool = True, checks: bool = True) -> list[dict]:
        """Constraints, parents first; what is there already stays, what a database refuses is reported, and the rest goes on."""
        from tidemark.operators.constraints import fk_levels
        from tidemark.plans import sqltext

        if not self.ddl:
            return []
        kind, names, out = self.db.kind, {t.name: t for t in tables}, []
        keyed, there = {}, {}
        for t in tables:
            keyed[t.name], there[t.name] = self.made(t.name)

        def attempt(table: str, what: str, sql: str | None) -> None:
            if sql and what.lower() not in there[table]:
                try:
                    execute(self.spark, self.db, [sql])
                except Exception as e:  # told, not fatal
                    if not _says(e, _TAKEN):
                        out.append({"table": table, "constraint": what, "error": said(e)})

        for t in tables:
            if t.key and kind != "mssql" and not keyed[t.name]:
                attempt(t.name, "primary key", sqltext.add_key(kind, self.schema, t))
            for i in t.indexes:
                attempt(t.name, i.name, sqltext.add_index(kind, self.schema, t, i))
        for level in fk_levels(tables):
            for name in level:
                for f in names[name].foreign_keys if references else ():
                    attempt(name, f.name, sqltext.add_reference(kind, self.schema, name, f))
                for c in names[name].checks if checks else ():
                    attempt(name, c.name, sqltext.add_check(kind, self.schema, name, c))
        for t in tables:
            for c in (c for c in t.columns if c.identity):
                top = self.table(t).read().agg({c.name: "max"}).first()[0]
                attempt(t.name, "sequence", sqltext.reset_sequence(kind, self.schema, t.name, c.name, top))
        return out
