"""Formulas for workers, chunks and batches, kept for configurations that name them."""

from __future__ import annotations

from tidemark.model import ColumnMeta


def clamp(x: int, low: int, high: int) -> int:
    return max(low, min(high, x))


def workers(cores: int) -> int:
    return clamp(cores // 2, 4, 16)


def readers(cores: int) -> int:
    return clamp(cores // 4, 2, 16)


def writers(cores: int, target: str) -> int:
    return 2 if target == "mssql" else clamp(cores // 4, 2, 16)


def memory_percent(value: int | None) -> int:
    return clamp(70 if value is None else value, 1, 100)


def read_ahead(ram_gb: int) -> int:
    return clamp(ram_gb // 4, 4, 32)


def chunk_cap(budget: int, row_bytes: int, ahead: int, worker_count: int) -> int:
    """Rows of a chunk that the memory budget allows."""
    return max(10_000, budget // max(1, row_bytes * ahead * worker_count * 2))


def chunk_rows(mode: str, ram_gb: int, cap: int) -> int:
    if mode == "upsert":
        return min(50_000, cap)
    return min(max(75_000 + ram_gb * 25_000 // 8, 50_000), cap, 200_000)


def large_table(ram_gb: int) -> int:
    return clamp(ram_gb // 8 * 1_000_000, 1_000_000, 20_000_000)


def source_connections(worker_count: int, reader_count: int) -> int:
    return clamp(worker_count * reader_count + 4, 8, 80)


def target_connections(worker_count: int, writer_count: int) -> int:
    return clamp(worker_count * writer_count + 4, 8, 64)


def fallback_batch_rows(columns: int) -> int:
    """Rows of a multi-row INSERT into SQL Server: 2100 parameters and 1000 rows at most."""
    return clamp(2100 // max(columns, 1), 1, 1000)


def mysql_batch_rows(columns: int) -> int:
    return max(1, 65_535 // max(columns, 1))


# Guessed bytes of a value by native type.
_BYTES = {
    "mssql": {"int": 4, "bigint": 8, "smallint": 2, "tinyint": 1, "bit": 1, "float": 8, "real": 4, "datetime": 8, "datetime2": 8, "date": 3, "time": 5, "uniqueidentifier": 16},
    "postgres": {
        "int2": 2, "smallint": 2, "int4": 4, "integer": 4, "int": 4, "int8": 8, "bigint": 8, "float4": 4, "real": 4, "float8": 8, "double precision": 8, "bool": 1, "boolean": 1,
        "uuid": 16, "date": 4, "time": 8, "timetz": 8, "timestamp": 8, "timestamptz": 8, "bytea": 100, "numeric": 16, "decimal": 16, "json": 100, "jsonb": 100,
    },
}
_TEXT = {"mssql": {"varchar", "nvarchar", "char", "nchar"}, "postgres": {"varchar", "character varying", "text", "char", "character"}}


def column_bytes(c: ColumnMeta, source: str = "postgres") -> int:
    if c.native in _TEXT[source]:
        if source == "mssql":
            return 100 if c.length == -1 else min(c.length, 100)
        return min(c.length, 100) if c.length > 0 else 100
    return _BYTES[source].get(c.native, 8)


def row_bytes(columns: tuple[ColumnMeta, ...], source: str = "postgres") -> int:
    return sum(column_bytes(c, source) for c in columns)


def mean_row_bytes(tables: list[tuple[int, int]]) -> int:
    """Mean of (rows, bytes of a row), weighted by rows; 500 where nothing is known."""
    rows = sum(n for n, _ in tables)
    return sum(n * b for n, b in tables) // rows if rows else 500
