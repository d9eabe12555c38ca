"""Intermediate tables in the folder that all executors share.

A written table cuts lineage: whoever loses an executor reads the files again. The folder is
``spark.checkpoint.dir`` of the session. Only a single-process ``local`` master may go without the
setting; its tables then lie in a temporary folder that goes with the process. Tables go with their block
(``cleared``), else when the JVM ends in order; a killed one leaves them.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: From so many buckets on, rows are dealt out before they are written: else each task would write a file for each bucket.
WIDE = 2000
_LOCAL: list[str] = []
_KEPT: list[str] = []
_TABLES: list[str] = []


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a reader of what was written."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _remember(spark, path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._tidemark_path = path
    return kept


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _remember(spark: SparkSession, path: str) -> None:
    """The file system deletes the folder when the JVM ends in order, even if the session was stopped long before."""
    _KEPT.append(path)
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)
    fs.cancelDeleteOnExit(p)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that ``keep`` returned; it must not be read afterwards."""
    _delete(df.sparkSession, df._tidemark_path)
    if df._tidemark_path in _KEPT:
        _KEPT.remove(df._tidemark_path)


def keep_by(df: DataFrame, label: str, *columns: str) -> DataFrame:
    """Write ``df`` in buckets of ``columns``: later joins and groups by them do not shuffle what was kept."""
    spark = df.sparkSession
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartition(buckets, *columns) if buckets >= WIDE else df
    writer = df.write.bucketBy(buckets, *columns).sortBy(*columns).option("compression", "zstd")
    path = f"{shared_root(spark)}/{name}"
    writer.option("path", path).saveAsTable(name)
    _remember(spark, path)
    _TABLES.append(name)
    return spark.table(name)


def clear(spark: SparkSession) -> None:
    """Delete the tables that this process kept; results that read them must have been written before."""
    for name in _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    _TABLES.clear()
    for path in _KEPT:
        _delete(spark, path)
    _KEPT.clear()


@contextlib.contextmanager
def cleared(spark: SparkSession):
    """What is kept in this block goes at its end; write the results inside it."""
    before, tables = list(_KEPT), list(_TABLES)
    _KEPT.clear()
    _TABLES.clear()
    try:
        yield
    finally:
        clear(spark)
        _KEPT.extend(before)
        _TABLES.extend(tables)
