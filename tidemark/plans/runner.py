"""Runs: catalog, filter, copy or merge each table, check constraints, keep state, report."""

from __future__ import annotations

import contextlib
import datetime as dt
import functools
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import tuning
from tidemark.functions.tolerant import Conversion
from tidemark.functions.types import DIALECTS
from tidemark.model import ParquetCatalog, TableMeta
from tidemark.operators import constraints, hashtree, merge, partition, preflight, scan, splits, verify
from tidemark.plans.config import Config, ConfigError, keeps
from tidemark.plans.progress import Stop, rows_in_flight, tagged
from tidemark.scratch import drop
from tidemark.sources import jdbc
from tidemark.sources.files import VersionedTable
from tidemark.sources.ledger import FolderLedger
from tidemark.streaming import state as states

# Exit codes by kind of failure, and the kinds a retry may mend.
EXIT_CODES = {"ok": 0, "config": 1, "connection": 2, "transfer": 3, "validation": 4, "cancelled": 5, "state": 6, "io": 7}
RECOVERABLE = {"connection", "cancelled", "io"}
#: Rows of a part where the settings name no chunk size: a table of twice as many is copied in parts.
RANGE_ROWS = 20_000_000
#: Seconds that work under way gets to end when a run is told to stop.
GRACE = 5.0


class Cancelled(RuntimeError):
    """The run was told to stop; nothing is finalised."""


def tag_of(run: str, table: str) -> str:
    """The tag of a table's jobs; commas separate tags."""
    return f"{run}:{table.replace(',', ' ')}"


def kind_of(error: BaseException) -> str:
    if isinstance(error, ConfigError):
        return "config"
    if isinstance(error, merge.NoPrimaryKey):
        return "validation"
    if isinstance(error, Cancelled):
        return "cancelled"
    if isinstance(error, OSError):
        return "io"
    return "transfer"


@dataclass
class Result:
    run_id: str
    status: str
    started_at: str
    completed_at: str = ""
    duration_seconds: float = 0.0
    tables_total: int = 0
    tables_success: int = 0
    tables_failed: int = 0
    rows_transferred: int = 0
    rows_skipped: int = 0
    rows_per_second: int = 0
    failed_tables: list[str] = field(default_factory=list)
    table_errors: list[dict] = field(default_factory=list)
    violations: list[dict] = field(default_factory=list)
    error: str | None = None
    error_type: str | None = None
    recoverable: bool | None = None

    def exit_code(self) -> int:
        return EXIT_CODES[self.error_type or ("transfer" if self.tables_failed else "ok")]

    def as_dict(self) -> dict:
        return {k: v for k, v in asdict(self).items() if v is not None}


class ParquetSource:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.catalog = ParquetCatalog(spark, root)

    def tables(self) -> list[TableMeta]:
        return [self.catalog.meta(n) for n in self.catalog.names()]

    def read(self, table: TableMeta) -> DataFrame:
        return self.catalog.table(table.name)

    def _files(self, table: TableMeta) -> list[tuple[str, int]]:
        """Paths below the table's folder and bytes, in order; one file is a table too."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table.name}.parquet")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        top, found, walk = fs.getFileStatus(path).getPath().toString(), [], fs.listFiles(path, True)
        while walk.hasNext():
            f = walk.next()
            name = f.getPath().toString()[len(top) :].lstrip("/")
            if not any(x.startswith(("_", ".")) for x in name.split("/")):
                found.append((name, f.getLen()))
        return sorted(found)

    def parts(self, table: TableMeta, rows: int) -> list[dict]:
        """Bounds of parts of about so many rows: groups of files, so that none is read twice; of few large files ranges
        of the key, which their statistics prune. Rows come from the files' footers. None where one part is enough."""
        df = self.read(table)
        n = df.count()
        count = -(-n // rows)
        if n < 2 * rows:
            return []
        files = self._files(table)
        if len(files) < count:
            if not table.key:
                return []
            cuts = [None, *splits.cut_points(df, list(table.key), count, n), None]
            return [{"after": a, "upto": b} for a, b in zip(cuts, cuts[1:], strict=False)] if len(cuts) > 2 else []
        out, held, size, share = [], [], 0, sum(b for _, b in files) / count
        for name, length in files:
            held.append(name)
            size += length
            if size >= share:
                out.append({"files": held})
                held, size = [], 0
        return [*out, {"files": held}] if held else out

    def read_part(self, table: TableMeta, bound: dict) -> DataFrame:
        df = self.read(table)
        if "files" in bound:
            at = f"{self.root}/{table.name}.parquet"
            names = [f"{at}/{f}" if f else at for f in bound["files"]]
            return self.spark.read.option("basePath", at).schema(df.schema).parquet(*names) if names != [at] else df
        return splits.between(df, list(table.key), bound["after"], bound["upto"])


# Native types of whole numbers, and of other values that compare alike in Spark and in a database.
_WHOLE = {"int", "integer", "bigint", "smallint", "tinyint", "int2", "int4", "int8", "mediumint", "serial", "bigserial"}
_ALIKE = {"decimal", "numeric", "date"}


class JdbcSource:
    """Tables of a database; one is read between cut points of its key, as many as its rows, memory and readers call for."""

    def __init__(self, spark: SparkSession, db: jdbc.Database, schema: str, readers: int = 0, ram_gb: int = 16):
        self.spark, self.db, self.schema = spark, db, schema
        self.readers, self.ram_gb = readers or tuning.readers(spark.sparkContext.defaultParallelism), ram_gb

    def tasks(self, table: TableMeta) -> int:
        cap = tuning.chunk_cap(self.ram_gb << 30, tuning.row_bytes(table.columns, self.db.kind if self.db.kind == "mssql" else "postgres"), tuning.read_ahead(self.ram_gb), self.readers)
        least = tuning.chunk_rows("drop_recreate", self.ram_gb, cap)
        return partition.partition_count(table.rows, least, self.readers, least) if table.rows else self.readers

    def tables(self) -> list[TableMeta]:
        return jdbc.load_catalog(self.spark, self.db, self.schema)

    def _kinds(self, table: TableMeta) -> list[str]:
        return [(c.native if (c := table.column(k)) else "").lower() for k in table.key]

    def _name(self, table: TableMeta) -> str:
        return jdbc.name_in(self.db, self.schema, table.name)

    def rows(self, table: TableMeta) -> int:
        """As the catalog tells, else counted by the database."""
        return table.rows or int(jdbc.query(self.spark, self.db, f"SELECT COUNT(*) AS n FROM {self._name(table)}").first()[0])

    def cut_points(self, table: TableMeta, parts: int, n: int) -> list[list[str | None]]:
        """Cut points with equally many rows between: numbered by the database, in its own order of text and uuids; where it
        cannot, from a sample of its keys, if these are numbers or dates."""
        from tidemark.plans import sqltext

        keys = list(table.key)
        if not keys or parts < 2 or n < 2:
            return []
        try:
            rows = jdbc.query(self.spark, self.db, sqltext.cut_points(self.db.kind, self.schema, table.name, keys, max(1, -(-n // parts)))).collect()
            return [[None if v is None else str(v) for v in list(r)[1:]] for r in sorted(rows, key=lambda r: r[0])][: parts - 1]
        except Exception:  # no window functions there
            if not set(self._kinds(table)) <= _WHOLE | _ALIKE:
                return []
            names = ", ".join(jdbc.quote(self.db.kind, k) for k in keys)
            return splits.cut_points(jdbc.query(self.spark, self.db, f"SELECT {names} FROM {self._name(table)}").toDF(*keys), keys, parts, n)

    def _between(self, table: TableMeta, cuts: list) -> DataFrame:
        numbers = {k for k, kind in zip(table.key, self._kinds(table), strict=True) if kind in _WHOLE | {"decimal", "numeric"}}
        return jdbc.read_between(self.spark, self.db, jdbc.readable(self.db, self.schema, table), list(table.key), cuts, numbers)

    def read(self, table: TableMeta) -> DataFrame:
        parts = self.tasks(table)
        cuts = self.cut_points(table, parts, self.rows(table)) if parts > 1 else []
        return self._between(table, [None, *cuts, None]) if cuts else jdbc.read_table(self.spark, self.db, jdbc.readable(self.db, self.schema, table))

    def parts(self, table: TableMeta, rows: int) -> list[dict]:
        """Bounds of parts of about so many rows, each with the cut points between which its tasks read."""
        n = self.rows(table)
        if n < 2 * rows:
            return []
        count = -(-n // rows)
        cuts = [None, *self.cut_points(table, count * self.readers, n), None]
        if len(cuts) < 3:
            return []
        step = -(-(len(cuts) - 1) // count)
        return [{"cuts": cuts[i : i + step + 1]} for i in range(0, len(cuts) - 1, step)]

    def read_part(self, table: TableMeta, bound: dict) -> DataFrame:
        return self._between(table, bound["cuts"])


class FolderState:
    """States of runs as a versioned table."""

    def __init__(self, store: VersionedTable):
        self.store = store

    def exists(self) -> bool:
        return self.store.exists()

    def read(self) -> DataFrame:
        return self.store.read()

    def save(self, rows: list[tuple], status: str, run: str, at: dt.datetime | None) -> None:
        """The rows of this run; with ``at`` the end is that of the whole run, what an earlier part of it had done too."""
        spark = self.store.spark
        saved = states.save(self.read() if self.exists() else states.empty(spark), spark.createDataFrame(rows, states.SCHEMA))
        if at:
            own = F.col("run_id") == run
            saved = saved.withColumns({"run_status": F.when(own, F.lit(status)).otherwise(F.col("run_status")), "run_completed_at": F.when(own, F.lit(at)).otherwise(F.col("run_completed_at"))})
            saved = saved.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in states.SCHEMA.fields])
        self.store.publish(saved)


class FolderTarget:
    """Versioned parquet tables under one folder, and the state beside them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, meta: TableMeta) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{meta.name}")

    def state(self) -> FolderState:
        return FolderState(VersionedTable(self.spark, f"{self.root}/_state"))

    def ledger(self) -> FolderLedger:
        """Parts that runs have copied into tables which are not published yet."""
        return FolderLedger(VersionedTable(self.spark, f"{self.root}/_parts"))

    def discard(self, parts: list[tuple[str, str]]) -> None:
        """Delete folders of tables, unless they were published."""
        for table, folder in parts:
            VersionedTable(self.spark, f"{self.root}/{table}").discard([folder])

    def rejects(self) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/_rejects")

    def reject(self, rows: DataFrame) -> None:
        """Keep values that did not fit: run_id, table_name, row_key, column_name, value."""
        self.rejects().append(rows)

    def finalise(self, tables: list[TableMeta], references: bool = True, checks: bool = True) -> list[dict]:
        """What the constraints of the source would refuse in the target: files enforce none."""
        out, names = [], {t.name: t for t in tables}
        for level in constraints.fk_levels(tables):
            for name in level:
                t, df = names[name], self.table(names[name]).read()
                found = [("primary key", constraints.pk_duplicates(df, list(t.key)))] if t.key else []
                for f in t.foreign_keys if references else ():
                    if f.parent in names:
                        found.append((f.name, constraints.fk_orphans(df, list(f.columns), self.table(names[f.parent]).read(), list(f.parent_columns))))
                found += [(c.name, constraints.check_violations(df, c.definition)) for c in t.checks] if checks else []
                out += [{"table": name, "constraint": what, "rows": n} for what, bad in found if (n := bad.count())]
        return out

    def check_changes(self, tables: list[TableMeta], changed: dict[str, DataFrame], references: bool = True, checks: bool = True) -> list[dict]:
        """What the constraints would refuse of the rows that a merge brought. A merge takes no key away, so only these rows can
        break one; of a parent only the files are read that may hold a key they refer to."""
        out, names = [], {t.name: t for t in tables}
        for level in constraints.fk_levels(tables):
            for name in (n for n in level if n in changed):
                t, df = names[name], changed[name]
                found = [("primary key", constraints.pk_duplicates(df, list(t.key)))]
                for f in t.foreign_keys if references else ():
                    if f.parent in names and (parent := self.table(names[f.parent])).exists():
                        there = parent.holding(df, list(f.parent_columns), list(f.columns))
                        found.append((f.name, constraints.fk_orphans(df, list(f.columns), there, list(f.parent_columns))))
                found += [(c.name, constraints.check_violations(df, c.definition)) for c in t.checks] if checks else []
                out += [{"table": name, "constraint": what, "rows": n} for what, bad in found if (n := bad.count())]
        return out


class Runner:
    """A run saves the state of each table as it ends, and of each range of a large one, so that another can go on from there."""

    def __init__(self, spark: SparkSession, config: Config, source, target, clock=None, progress=None, every: float | None = None, grace: float = GRACE):
        """``progress`` gets a dict for each event of a table and, with ``every``, where the run stands each so many seconds.

        Setting ``cancel`` ends a run: work under way gets ``grace`` seconds, then its jobs are interrupted.
        """
        self.spark, self.config, self.source, self.target, self.every, self.grace = spark, config, source, target, every, grace
        self.progress = progress or (lambda event: None)
        self.clock = clock or (lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
        self.cancel = threading.Event()
        self.lock = threading.Lock()
        self.saving = threading.Lock()
        self.active: dict[str, int] = {}
        self.changed: dict[str, DataFrame] = {}

    def tables(self) -> list[TableMeta]:
        m = self.config.migration
        return [t for t in self.source.tables() if keeps(t.name, m.include_tables, m.exclude_tables)]

    def saved_state(self) -> DataFrame:
        store = self.target.state()
        return store.read() if store.exists() else states.empty(self.spark)

    def run(self, dry: bool = False, resume: bool = False) -> Result:
        began, clock = self.clock(), time.monotonic()
        mode = self.config.migration.target_mode
        result = Result(uuid.uuid4().hex, "completed", began.isoformat())
        try:
            tables = every = self.tables()
            result.tables_total = len(tables)
            old = self.saved_state()
            marks = {r["table_name"]: r["last_sync_timestamp"] for r in states.last_sync(old).collect()}
            # Only a run that did not end is gone on with; an ended one never lends its name or its finished tables.
            if resume and (row := states.resumable_run(old, self.config.fingerprint()).select("run_id").first()):
                result.run_id = row["run_id"]
                tables = self._pending(tables, old.filter(F.col("run_id") == result.run_id), mode)
            if mode == "upsert" and (bare := [t.name for t in tables if not t.key]):
                raise merge.NoPrimaryKey(f"no primary key: {', '.join(bare)}")
            if dry:
                result.status = "dry_run"
                return self._ended(result, clock)
            self._sweep(old)
            with Stop(self.spark, result.run_id, self.cancel, self.grace), self._ticking(result), ThreadPoolExecutor(self.config.migration.workers or 4) as pool:
                rows = list(pool.map(lambda t: self._one(t, mode, marks.get(t.name), result, began), tables))
            if self.cancel.is_set():
                if ended := [r for r in rows if r[6] != "pending"]:
                    self._save(ended, "cancelled", result.run_id)
                raise Cancelled("cancelled")
            if mode == "drop_recreate" and not result.tables_failed:
                m = self.config.migration
                # All tables, those that an earlier part of the run had done too.
                result.violations = self.target.finalise(every, m.create_foreign_keys, m.create_check_constraints)
            elif self.changed:
                m = self.config.migration
                result.violations = self.target.check_changes(every, self.changed, m.create_foreign_keys, m.create_check_constraints)
            self._save(rows, "failed" if result.tables_failed else "completed", result.run_id)
            result.status = "failed" if result.tables_failed else "completed"
        except Exception as e:
            result.status = "cancelled" if isinstance(e, Cancelled) else "failed"
            result.error, result.error_type = str(e), kind_of(e)
            result.recoverable = result.error_type in RECOVERABLE
        finally:
            for kept in self.changed.values():
                drop(kept)
            self.changed.clear()
        return self._ended(result, clock)

    def _sweep(self, state: DataFrame) -> None:
        """Drop what ended or superseded runs had copied and never published; of runs that the state does not know nothing is touched."""
        ledger = self.target.ledger()
        if begun := ledger.runs():
            last = state.groupBy("config_hash").agg(F.max_by("run_id", F.struct("run_started_at", "run_id")).alias("last"))
            own = state.filter(F.col("run_id").isin(begun)).join(last, "config_hash")
            gone = own.filter("run_id <> last OR run_status = 'completed'").select("run_id").distinct()
            self.target.discard(ledger.forget([r["run_id"] for r in gone.collect()]))

    def _pending(self, tables: list[TableMeta], state: DataFrame, mode: str) -> list[TableMeta]:
        """Tables that a resumed run still has to do: of a merge with marks all, else those that did not end well."""
        names = self.spark.createDataFrame([(t.name,) for t in tables], "table_name string")
        marked = mode == "upsert" and bool(self.config.migration.date_updated_columns)
        left = {r["table_name"] for r in states.pending_tables(names, state, "upsert", marked).collect()}
        return [t for t in tables if t.name in left]

    @contextlib.contextmanager
    def _ticking(self, result: Result):
        """Tells, each ``every`` seconds, how many tables are done, which are under way and the rows so far."""
        done, most = threading.Event(), {}

        def tick():
            while not done.wait(self.every):
                with self.lock:
                    active = dict(self.active)
                flying = {t: rows_in_flight(self.spark, tag_of(result.run_id, t)) for t in active}
                with self.lock:
                    # Between a job's end and its count a table keeps what it had.
                    active = {t: max(n + flying[t], most.get(t, 0)) for t, n in active.items()}
                    most.update(active)
                    self.progress({"event": "progress", "done": result.tables_success + result.tables_failed, "of": result.tables_total, "rows": result.rows_transferred + sum(active.values()), "active": sorted(active)})

        teller = threading.Thread(target=tick, daemon=True) if self.every else None
        if teller:
            teller.start()
        try:
            yield
        finally:
            done.set()
            if teller:
                teller.join()

    def _ended(self, result: Result, clock: float) -> Result:
        result.duration_seconds = time.monotonic() - clock
        result.completed_at = self.clock().isoformat()
        result.rows_per_second = int(result.rows_transferred / max(result.duration_seconds, 1e-3))
        return result

    def _copy(self, table: TableMeta, store, run: str, begun: tuple) -> int:
        """The whole table into ``store``: at once, or, if it is large, part by part.

        The plan of the parts is saved first, and ``begun``, the table's state, so that a run that dies can be gone on with. That
        leaves out the parts that are marked as done. In files all parts are published together; in a database each is committed
        with its mark.
        """
        ledger = self.target.ledger()
        plan = ledger.rows(run, table.name)
        if not plan:
            bounds = self.source.parts(table, self.config.migration.chunk_size or RANGE_ROWS)
            if len(bounds) < 2:
                return store.publish(self.source.read(table))
            self._save([begun], "running", run)
            with self.saving:
                ledger.begin(run, table.name, bounds, store)
            plan = [{"partition_id": i, "bounds": b, "row_count": None} for i, b in enumerate(bounds)]
        rows = sum(p["row_count"] or 0 for p in plan)
        for p in plan:
            if p["row_count"] is not None:
                continue
            if self.cancel.is_set():
                raise Cancelled("cancelled")
            own = self.source.read_part(table, p["bounds"])
            rows += ledger.put(run, table.name, p["partition_id"], p["bounds"], own, store, self.saving)
            with self.lock:
                self.active[table.name] = rows
        with self.saving:
            ledger.finish(run, table.name, store)
        return rows

    def _convert(self, table: TableMeta, types: dict[str, str], store, run: str, mode: str) -> tuple[int, int]:
        """Rows whose values fit go on, the others to the rejects; the numbers of both. Too many fail the table before anything is written."""
        parts = Conversion(self.source.read(table), types, list(table.key), self.config.migration.reject_limit)
        try:
            counts = parts.counts()
            if counts["rejected"]:
                key = F.to_json(F.struct(*table.key)) if table.key else F.lit(None).cast("string")
                with self.saving:
                    self.target.reject(parts.rejects.select(F.lit(run).alias("run_id"), F.lit(table.name).alias("table_name"), key.alias("row_key"), "column_name", "value"))
            if mode == "drop_recreate" or not store.exists():
                store.publish(parts.good)
            else:
                store.merge(parts.good, list(table.key))
            return counts["rows"] - counts["rejected"], counts["rejected"]
        finally:
            parts.close()

    def _one(self, table: TableMeta, mode: str, mark, result: Result, began: dt.datetime) -> tuple:
        started, error, rows, skipped = self.clock(), None, 0, 0
        row = [result.run_id, self.config.fingerprint(), began, None, "running", table.name]
        if self.cancel.is_set():
            return (*row, "pending", 0, 0, 0, None, None, None, None, self.clock())
        with self.lock:
            self.active[table.name] = 0
        try:
            with tagged(self.spark, result.run_id, tag_of(result.run_id, table.name)):
                store = self.target.table(table)
                if types := self.config.migration.convert.get(table.name):
                    rows, skipped = self._convert(table, types, store, result.run_id, mode)
                elif mode == "drop_recreate" or not store.exists():
                    begun = (*row, "in_progress", 0, 0, 0, None, None, None, None, self.clock())
                    rows = self._copy(table, store, result.run_id, begun)
                else:
                    df = self.source.read(table)
                    column = scan.pick_watermark_column(df, self.config.migration.date_updated_columns)
                    changes = scan.watermark_filter(df, column[0], mark) if column else df
                    if hasattr(self.target, "check_changes"):
                        rows, kept = store.merge_kept(changes, list(table.key))
                        with self.lock:
                            self.changed[table.name] = kept
                    else:
                        rows = store.merge(changes, list(table.key))
        except Exception as e:
            error = "cancelled" if self.cancel.is_set() else (str(e).splitlines() or [type(e).__name__])[0]
            with self.lock:
                result.tables_failed += 1
                result.failed_tables.append(table.name)
                result.table_errors.append({"table": table.name, "error_type": kind_of(e), "message": error})
        else:
            with self.lock:
                result.tables_success += 1
                result.rows_transferred += rows
        status = "failed" if error else "completed"
        with self.lock:
            self.active.pop(table.name, None)
            self.progress({"event": "table", "table": table.name, "status": status, "rows": rows, "done": result.tables_success + result.tables_failed, "of": result.tables_total})
        out = (*row, status, rows, rows, skipped, None, states.mark_of_run(started, bool(error)), None if error else self.clock(), error, self.clock())
        self._save([out], "running", result.run_id)
        return out

    def _save(self, rows: list[tuple], status: str, run: str) -> None:
        at = None if status == "running" else self.clock()
        with self.saving:
            self.target.state().save([(*r[:3], at, status, *r[5:]) for r in rows], status, run, at)

    def validate(self) -> DataFrame:
        """Counts of both sides by table, for the tables that the filters keep."""
        tables = self.tables()
        there = {t.name: self.target.table(t) for t in tables}
        source = verify.table_counts({t.name: self.source.read(t) for t in tables}) if tables else verify.empty_counts(self.spark)
        found = {n: t.read() for n, t in there.items() if t.exists()}
        return verify.reconcile(source, verify.table_counts(found) if found else verify.empty_counts(self.spark))

    def preflight(self, source: str, sink: str) -> DataFrame:
        """table_name and, of each column, what the target's type loses and how many values it would refuse, before anything is written.

        ``source`` is the dialect that describes the columns. Files refuse nothing: for a sink that is no database there are no rows.
        """
        found = []
        for t in self.tables() if sink in DIALECTS else ():
            need = tuple(replace(c, nullable=False) if c.name in t.key else c for c in t.columns)
            found.append(preflight.fit(self.source.read(t), need, source, sink).select(F.lit(t.name).alias("table_name"), "*"))
        return functools.reduce(DataFrame.unionByName, found) if found else preflight.nothing(self.spark).select(F.lit("").alias("table_name"), "*")

    def differences(self, name: str) -> DataFrame:
        """Keys of a table whose rows are missing, extra or different in the target, by trees of hashes."""
        table = next(t for t in self.tables() if t.name == name)
        source, target = self.source.read(table), self.target.table(table).read()
        return hashtree.tree_diff(source, target.select(*source.columns), list(table.key), source.columns)

    def health(self) -> dict:
        out = {}
        for side, probe in (("source", lambda: self.source.tables()), ("target", lambda: self.target.state().exists())):
            began = time.monotonic()
            try:
                probe()
                out |= {f"{side}_connected": True}
            except Exception as e:
                out |= {f"{side}_connected": False, f"{side}_error": str(e).splitlines()[0]}
            out[f"{side}_latency_ms"] = int((time.monotonic() - began) * 1000)
        return {"healthy": out["source_connected"] and out["target_connected"]} | out
