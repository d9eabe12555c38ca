"""What a run has copied of a large table, part by part, and the state of runs: in files or in the target database.

Before the first part is copied the plan of all parts is written down; a run that goes on takes up that plan and
leaves out the parts that are marked as done, whatever the key's type and whichever parts they are.
"""

from __future__ import annotations

import datetime as dt
import json
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.idents import quote
from tidemark.sources.files import VersionedTable
from tidemark.sources.jdbc import Database, JdbcTable, execute, present, query
from tidemark.streaming import state as states

#: Longest text of an error that a database keeps.
ERROR = 4000


class FolderLedger:
    """The parts of a version that is not published yet are folders; the ledger is a versioned table beside them."""

    def __init__(self, store: VersionedTable):
        self.store = store

    def rows(self, run: str, table: str) -> list[dict]:
        """Parts in order: partition_id, bounds, and row_count and folder once copied."""
        if not self.store.exists():
            return []
        own = self.store.read().filter((F.col("run_id") == run) & (F.col("table_name") == table))
        last = own.groupBy("partition_id").agg(F.max("bounds").alias("bounds"), F.max("row_count").alias("row_count"), F.max("folder").alias("folder"))
        return [{**r.asDict(), "bounds": json.loads(r["bounds"])} for r in last.orderBy("partition_id").collect()]

    def begin(self, run: str, table: str, bounds: list[dict], into: VersionedTable) -> None:
        self._append([(run, table, i, json.dumps(b), None, None) for i, b in enumerate(bounds)])

    def put(self, run: str, table: str, part: int, bound: dict, df: DataFrame, into: VersionedTable, lock) -> int:
        """Write a part's folder, then mark it; tables that are copied at once mark theirs one after the other."""
        folder, count = into.stage(df, run, part)
        with lock:
            self._append([(run, table, part, json.dumps(bound), count, folder)])
        return count

    def finish(self, run: str, table: str, into: VersionedTable) -> None:
        """Publish all parts together and forget the plan."""
        into.point([r["folder"] for r in self.rows(run, table)])
        left = self.store.read().filter(~((F.col("run_id") == run) & (F.col("table_name") == table)))
        self.store.publish(left)

    def runs(self) -> list[str]:
        return [r["run_id"] for r in self.store.read().select("run_id").distinct().collect()] if self.store.exists() else []

    def forget(self, runs: list[str]) -> list[tuple[str, str]]:
        """Drop the plans of these runs; (table, folder) of what they had copied."""
        if not runs:
            return []
        rows = self.store.read()
        own = F.col("run_id").isin(runs)
        found = [(r["table_name"], r["folder"]) for r in rows.filter(own & F.col("folder").isNotNull()).select("table_name", "folder").collect()]
        self.store.publish(rows.filter(~own))
        return found

    def _append(self, rows: list[tuple]) -> None:
        self.store.append(self.store.spark.createDataFrame(rows, states.PARTS))


# Names of types for the tables of state in each database.
_TYPES = {
    "postgres": {"text": "varchar({n})", "long": "bigint", "int": "integer", "time": "timestamp"},
    "mysql": {"text": "varchar({n})", "long": "bigint", "int": "integer", "time": "datetime(6)"},
    "mssql": {"text": "nvarchar({n})", "long": "bigint", "int": "integer", "time": "datetime2(6)"},
}


class _Table:
    """A small table of the target database that is written row by row, each write one transaction."""

    def __init__(self, spark, db: Database, name: str, columns: dict[str, tuple[str, int]], keys: list[str]):
        self.spark, self.db, self.name, self.columns, self.keys = spark, db, name, columns, keys
        self.made = False

    def exists(self) -> bool:
        return self.made or present(self.spark, self.db, quote(self.db.kind, self.name))

    def make(self) -> None:
        if self.exists():
            self.made = True
            return
        kinds, q = _TYPES[self.db.kind], lambda c: quote(self.db.kind, c)
        lines = [f"{q(c)} {kinds[k].format(n=n)}{' NOT NULL' if c in self.keys else ''}" for c, (k, n) in self.columns.items()]
        execute(self.spark, self.db, [f"CREATE TABLE {q(self.name)} ({', '.join(lines)}, PRIMARY KEY ({', '.join(map(q, self.keys))}))"])
        self.made = True

    def put(self, rows: list[tuple]) -> list[tuple[str, list]]:
        """Statements that leave exactly these rows under their keys; running them twice changes nothing."""
        q = lambda c: quote(self.db.kind, c)
        at = [list(self.columns).index(k) for k in self.keys]
        gone = f"DELETE FROM {q(self.name)} WHERE {' AND '.join(f'{q(k)} = ?' for k in self.keys)}"
        new = f"INSERT INTO {q(self.name)} ({', '.join(map(q, self.columns))}) VALUES ({', '.join('?' * len(self.columns))})"
        out = []
        for r in rows:
            out += [(gone, [(r[i], self.columns[k][0]) for i, k in zip(at, self.keys, strict=True)]), (new, [(v, k) for v, (k, _) in zip(r, self.columns.values(), strict=True)])]
        return out

    def read(self, where: str = "1 = 1") -> DataFrame:
        found = query(self.spark, self.db, f"SELECT * FROM {quote(self.db.kind, self.name)} WHERE {where}", preferTimestampNTZ="true")
        return found.toDF(*[c.lower() for c in found.columns])


class JdbcState:
    """States of runs in the target database: rows are put by (run_id, table_name) and never read to be written."""

    def __init__(self, spark, db: Database):
        text = {"run_id": 64, "config_hash": 64, "run_status": 16, "table_name": 256, "table_status": 16, "error": ERROR}
        kind = lambda f: ("text", text[f.name]) if f.name in text else ("time", 0) if "imestamp" in f.dataType.simpleString() else ("long", 0)
        self.spark, self.db = spark, db
        self.table = _Table(spark, db, "sync_state", {f.name: kind(f) for f in states.SCHEMA.fields}, states.KEY)

    def exists(self) -> bool:
        return self.table.exists()

    def read(self) -> DataFrame:
        return self.table.read().select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in states.SCHEMA.fields])

    def save(self, rows: list[tuple], status: str, run: str, at: dt.datetime | None) -> None:
        """The rows of this run; with ``at`` the end is that of the whole run, what an earlier part of it had done too."""
        self.table.make()
        error = [f.name for f in states.SCHEMA.fields].index("error")
        cut = [(*r[:error], r[error] and r[error][: ERROR // 4], *r[error + 1 :]) for r in rows]
        q = lambda c: quote(self.db.kind, c)
        ended = f"UPDATE {q('sync_state')} SET {q('run_status')} = ?, {q('run_completed_at')} = ? WHERE {q('run_id')} = ?"
        execute(self.spark, self.db, [*self.table.put(cut), *([(ended, [(status, "text"), (at, "time"), (run, "text")])] if at else [])])


class JdbcLedger:
    """Parts are rows of a table of the target; a part's rows and its mark are committed by one transaction."""

    def __init__(self, spark, db: Database):
        columns = {"run_id": ("text", 64), "table_name": ("text", 256), "partition_id": ("int", 0), "bounds": ("text", ERROR), "row_count": ("long", 0), "folder": ("text", 256)}
        self.table = _Table(spark, db, "sync_ranges", columns, ["run_id", "table_name", "partition_id"])

    def _stage(self, run: str, table: str, part: int) -> str:
        return f"part_{run[:12]}_{zlib.crc32(table.encode()):08x}_{part}"

    def _own(self, run: str, table: str) -> str:
        from tidemark.functions.idents import literal

        return f"{quote(self.table.db.kind, 'run_id')} = {literal(run)} AND {quote(self.table.db.kind, 'table_name')} = {literal(table)}"

    def rows(self, run: str, table: str) -> list[dict]:
        if not self.table.exists():
            return []
        return [{"partition_id": r["partition_id"], "bounds": json.loads(r["bounds"]), "row_count": r["row_count"], "folder": r["folder"]} for r in sorted(self.table.read(self._own(run, table)).collect(), key=lambda r: r["partition_id"])]

    def begin(self, run: str, table: str, bounds: list[dict], into: JdbcTable) -> None:
        """An empty table, and the plan: a run that stops between the two begins again."""
        self.table.make()
        into.create()
        execute(self.table.spark, self.table.db, self.table.put([(run, table, i, json.dumps(b), None, None) for i, b in enumerate(bounds)]))

    def put(self, run: str, table: str, part: int, bound: dict, df: DataFrame, into: JdbcTable, lock) -> int:
        """The rows go to a stage that many connections fill; one transaction moves them and marks the part."""
        stage = self._stage(run, table, part)
        count = into.fill_stage(stage, df)
        moved = into.move_stage(stage, df.columns)
        execute(self.table.spark, self.table.db, [moved, *self.table.put([(run, table, part, json.dumps(bound), count, None)])])
        into.drop_stage(stage)
        return count

    def finish(self, run: str, table: str, into: JdbcTable) -> None:
        """The table is whole: the plan goes, and stages that a run left when it stopped after its last commit."""
        for r in self.rows(run, table):
            if present(self.table.spark, self.table.db, quote(self.table.db.kind, stage := self._stage(run, table, r["partition_id"]))):
                into.drop_stage(stage)
        into.loaded()
        execute(self.table.spark, self.table.db, [f"DELETE FROM {quote(self.table.db.kind, self.table.name)} WHERE {self._own(run, table)}"])

    def runs(self) -> list[str]:
        return [r["run_id"] for r in self.table.read().select("run_id").distinct().collect()] if self.table.exists() else []

    def forget(self, runs: list[str]) -> list[tuple[str, str]]:
        """Drop the plans of these runs; their rows lie in tables that the next run makes anew."""
        gone = f"DELETE FROM {quote(self.table.db.kind, self.table.name)} WHERE {quote(self.table.db.kind, 'run_id')} = ?"
        execute(self.table.spark, self.table.db, [(gone, [(r, "text")]) for r in runs])
        return []
