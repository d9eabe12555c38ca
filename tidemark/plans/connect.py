"""What a source and a target must be able to do, and which of them stands for each kind of endpoint.

A kind that is registered here (``register_source``, ``register_target``) can be named in the settings like the built-in ones.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.types import ALIASES, DIALECTS
from tidemark.model import TableMeta
from tidemark.plans.config import ConfigError, Endpoint
from tidemark.plans.runner import FolderTarget, JdbcSource, ParquetSource
from tidemark.sources.jdbc import Database, JdbcTarget


@runtime_checkable
class Source(Protocol):
    """Tables to read: whole, or by parts of which no row is in two."""

    def tables(self) -> list[TableMeta]: ...

    def read(self, table: TableMeta) -> DataFrame: ...

    def parts(self, table: TableMeta, rows: int) -> list[dict]: ...

    def read_part(self, table: TableMeta, bound: dict) -> DataFrame: ...


@runtime_checkable
class Store(Protocol):
    """One table of a target."""

    def exists(self) -> bool: ...

    def read(self) -> DataFrame: ...

    def publish(self, df: DataFrame) -> int: ...

    def merge(self, changes: DataFrame, keys: list[str]) -> int: ...


@runtime_checkable
class State(Protocol):
    """States of runs, a row for each run and table."""

    def exists(self) -> bool: ...

    def read(self) -> DataFrame: ...

    def save(self, rows: list[tuple], status: str, run: str, at: dt.datetime | None) -> None: ...


@runtime_checkable
class Ledger(Protocol):
    """Parts of tables that runs have planned and copied."""

    def rows(self, run: str, table: str) -> list[dict]: ...

    def begin(self, run: str, table: str, bounds: list[dict], into: Store) -> None: ...

    def put(self, run: str, table: str, part: int, bound: dict, df: DataFrame, into: Store, lock) -> int: ...

    def finish(self, run: str, table: str, into: Store) -> None: ...

    def runs(self) -> list[str]: ...

    def forget(self, runs: list[str]) -> list[tuple[str, str]]: ...


@runtime_checkable
class Target(Protocol):
    """Tables to write, and what is kept beside them. With ``check_changes`` it also checks constraints after a merge."""

    def table(self, meta: TableMeta) -> Store: ...

    def state(self) -> State: ...

    def ledger(self) -> Ledger: ...

    def discard(self, parts: list[tuple[str, str]]) -> None: ...

    def reject(self, rows: DataFrame) -> None: ...

    def finalise(self, tables: list[TableMeta], references: bool, checks: bool) -> list[dict]: ...


_SOURCES: dict[str, tuple[Callable[[SparkSession, Endpoint], Source], str]] = {}
_TARGETS: dict[str, Callable[[SparkSession, Endpoint, str], Target]] = {}


def register_source(kind: str, make: Callable[[SparkSession, Endpoint], Source], types: str = "postgres") -> None:
    """``types`` is the dialect in which its columns are described."""
    _SOURCES[kind] = (make, types)


def register_target(kind: str, make: Callable[[SparkSession, Endpoint, str], Target]) -> None:
    """``make`` also gets the dialect in which the source describes its columns."""
    _TARGETS[kind] = make


def kinds() -> dict[str, list[str]]:
    return {"sources": sorted(_SOURCES), "targets": sorted(_TARGETS)}


def types_of(kind: str) -> str:
    """The dialect in which a source describes its columns."""
    return _found(_SOURCES, kind, "source")[1]


def _found(registry: dict, kind: str, side: str):
    if (name := ALIASES.get(kind, kind)) not in registry:
        raise ConfigError(f"{side}.type {kind!r} is not one of {', '.join(sorted(registry))}")
    return registry[name]


def source_of(spark: SparkSession, end: Endpoint) -> Source:
    return _checked(_found(_SOURCES, end.kind(), "source")[0](spark, end), Source)


def target_of(spark: SparkSession, end: Endpoint, source_kind: str) -> Target:
    return _checked(_found(_TARGETS, end.kind(), "target")(spark, end, types_of(source_kind)), Target)


def _checked(made, protocol: type):
    if not isinstance(made, protocol):
        raise TypeError(f"{type(made).__name__} is no {protocol.__name__}")
    return made


def database(end: Endpoint) -> Database:
    return Database(end.kind(), end.host, end.database, end.port, end.user, end.password, end.ssl_mode)


register_source("parquet", lambda spark, end: ParquetSource(spark, end.path))
register_target("parquet", lambda spark, end, types: FolderTarget(spark, end.path))
for _kind in DIALECTS:
    register_source(_kind, lambda spark, end: JdbcSource(spark, database(end), end.schema), _kind)
    register_target(_kind, lambda spark, end, types: JdbcTarget(spark, database(end), end.schema, types))
