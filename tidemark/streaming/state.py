"""Run state as a table: what ran, how far it came, and from where the next run may go on."""

from __future__ import annotations

import datetime as dt
import hmac
import json
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.merge import upsert

SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("config_hash", T.StringType(), False),
        T.StructField("run_started_at", T.TimestampNTZType(), False),
        T.StructField("run_completed_at", T.TimestampNTZType()),
        T.StructField("run_status", T.StringType(), False),
        T.StructField("table_name", T.StringType(), False),
        T.StructField("table_status", T.StringType(), False),
        T.StructField("rows_total", T.LongType(), False),
        T.StructField("rows_transferred", T.LongType(), False),
        T.StructField("rows_skipped", T.LongType(), False),
        T.StructField("last_pk", T.LongType()),
        T.StructField("last_sync_timestamp", T.TimestampNTZType()),
        T.StructField("table_completed_at", T.TimestampNTZType()),
        T.StructField("error", T.StringType()),
        T.StructField("updated_at", T.TimestampNTZType(), False),
    ]
)
KEY = ["run_id", "table_name"]
#: Parts of tables that a run copies: what bounds them (JSON), and once copied their rows and where they lie.
PARTS = "run_id string, table_name string, partition_id int, bounds string, row_count long, folder string"


def save(state: DataFrame, rows: DataFrame) -> DataFrame:
    """The state after rows of (run, table) are put in; saving twice changes nothing."""
    return upsert(state, rows, KEY)


def latest_run(state: DataFrame, config_hash: str | None = None) -> DataFrame:
    """Rows of the last started run, of that configuration if given."""
    own = state if config_hash is None else state.filter(F.col("config_hash") == config_hash)
    last = own.agg(F.max_by("run_id", F.struct("run_started_at", "run_id")).alias("run_id"))
    return own.join(F.broadcast(last), "run_id", "left_semi")


def resumable_run(state: DataFrame, config_hash: str) -> DataFrame:
    """As latest_run, but only if that run did not complete: a new run never takes an ended run's name."""
    return latest_run(state, config_hash).filter("run_status <> 'completed'")


def last_sync(state: DataFrame) -> DataFrame:
    """table_name and last_sync_timestamp: the mark of the last completed sync that has one."""
    done = state.filter("table_status = 'completed' AND last_sync_timestamp IS NOT NULL")
    return done.groupBy("table_name").agg(F.max_by("last_sync_timestamp", F.struct("updated_at", "last_sync_timestamp")).alias("last_sync_timestamp"))


def pending_tables(tables: DataFrame, state: DataFrame, mode: str, has_marks: bool = False) -> DataFrame:
    """Tables still to be copied: all of them unless an upsert without marks goes on from an earlier run."""
    if mode == "drop_recreate" or has_marks:
        return tables
    return tables.join(state.filter("table_status = 'completed'"), "table_name", "left_anti")


def run_summary(state: DataFrame) -> DataFrame:
    done = F.col("table_status") == "completed"
    return state.groupBy("run_id").agg(
        F.count_if(done).alias("tables_success"),
        F.count_if(F.col("table_status") == "failed").alias("tables_failed"),
        F.coalesce(F.sum(F.when(done, F.col("rows_transferred"))), F.lit(0)).cast("long").alias("rows_transferred"),
        F.coalesce(F.sum(F.when(done, F.col("rows_skipped"))), F.lit(0)).cast("long").alias("rows_skipped"),
    )


def table_progress(parts: DataFrame) -> DataFrame:
    """Jobs of partitions summed by table; the first error, by partition, stands for the table."""
    return parts.groupBy("table_name").agg(
        F.sum("row_count").cast("long").alias("row_count"),
        F.count("*").alias("partitions"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("partition_id"))).alias("error"),
    )


def resume_point(ranges: DataFrame, start: int | None = None, by: list[str] | None = None) -> DataFrame:
    """resume_key: last key of the gapless run of completed ranges (first, last] from ``start`` on.

    ``ranges`` has range_start (null: from the beginning) and range_end. Ranges may overlap and come in any
    order. A gap ends the run; no range at the start gives null.
    """
    by = by or []
    first = F.coalesce("range_start", F.lit(start if start is not None else -(1 << 63)).cast("long"))
    w = Window.partitionBy(*by, F.lit(0)).orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)
    origin = F.lit(start if start is not None else -(1 << 63)).cast("long")
    rows = ranges.select(*by, first.alias("_a"), F.col("range_end").cast("long").alias("_b"))
    seen = rows.withColumn("_reach", F.greatest(F.coalesce(F.max("_b").over(w), origin), origin))
    gaps = seen.withColumn("_gap", F.max((F.col("_a") > F.col("_reach")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return gaps.groupBy(*by).agg(F.max(F.when(F.col("_gap") == 0, F.col("_b"))).alias("resume_key"))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


class SyncStream:
    """Upserts the batches of a stream of changes into a target that a store reads and publishes.

    Each batch is one row for each key (the last by ``order``) merged by a join and published whole, so a
    batch that runs again after a failure leaves the same target.
    """

    def __init__(self, read: Callable[[], DataFrame], publish: Callable[[DataFrame], None], keys: list[str], order: list):
        self.read, self.publish, self.keys, self.order = read, publish, keys, order

    def apply(self, batch: DataFrame, _: int) -> None:
        target = self.read()
        self.publish(upsert(target, batch.select(*target.columns, *[c for c in batch.columns if c not in target.columns]), self.keys, self.order).select(*target.columns))

    def start(self, changes: DataFrame, checkpoint: str, once: bool = False):
        writer = changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


def mark_of_run(started: dt.datetime, failed: bool) -> dt.datetime | None:
    """The next mark is the time the table's run began, and only if it succeeded."""
    return None if failed else started


def write_signed(path: str, rows: list[dict], secret: bytes) -> None:
    """State as a file with an HMAC over its content, replaced in one rename; for runs without a state table."""
    body = json.dumps(rows, sort_keys=True, default=str)
    sealed = json.dumps({"state": body, "hmac": hmac.new(secret, body.encode(), "sha256").hexdigest()})
    fd, fresh = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w") as f:
        f.write(sealed)
    os.replace(fresh, path)


def read_signed(path: str, secret: bytes) -> list[dict]:
    with open(path) as f:
        sealed = json.load(f)
    if not hmac.compare_digest(sealed["hmac"], hmac.new(secret, sealed["state"].encode(), "sha256").hexdigest()):
        raise ValueError("the state file was changed")
    return json.loads(sealed["state"])
