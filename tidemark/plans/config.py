"""Configuration files, their validation, table filters and fingerprint."""

from __future__ import annotations

import dataclasses
import fnmatch
import hashlib
import json
import os
import re
import warnings
from dataclasses import dataclass, field

from tidemark.functions.types import ALIASES, DIALECTS


class ConfigError(ValueError):
    exit_code = 1


@dataclass
class Endpoint:
    type: str = ""
    host: str = ""
    port: int = 0
    database: str = ""
    user: str = ""
    password: str = ""
    schema: str = ""
    ssl_mode: str = "prefer"
    encrypt: bool = False
    trust_server_cert: bool = True
    auth: str = "native"
    #: A folder of parquet tables in place of a database.
    path: str = ""

    def kind(self) -> str:
        name = self.type.lower().replace("_", "")
        return "parquet" if self.path and not name else ALIASES.get(name, name)


@dataclass
class Migration:
    target_mode: str = "drop_recreate"
    workers: int | None = None
    chunk_size: int | None = None
    max_partitions: int | None = None
    read_ahead_buffers: int | None = None
    write_ahead_writers: int | None = None
    parallel_readers: int | None = None
    max_mssql_connections: int | None = None
    max_pg_connections: int | None = None
    finalizer_concurrency: int | None = None
    copy_buffer_rows: int | None = None
    upsert_batch_size: int | None = None
    upsert_parallel_tasks: int | None = None
    use_binary_copy: bool | None = None
    large_table_threshold: int | None = None
    min_rows_per_partition: int | None = None
    memory_budget_percent: int | None = None
    include_tables: list[str] = field(default_factory=list)
    exclude_tables: list[str] = field(default_factory=list)
    date_updated_columns: list[str] = field(default_factory=list)
    create_indexes: bool = True
    create_foreign_keys: bool = True
    create_check_constraints: bool = True
    #: By table, the types that columns are converted to; rows that do not fit go to a table of rejects.
    convert: dict[str, dict[str, str]] = field(default_factory=dict)
    #: Most rejected rows of a table before it fails; no limit if not given.
    reject_limit: int | None = None


@dataclass
class Config:
    source: Endpoint = field(default_factory=Endpoint)
    target: Endpoint = field(default_factory=Endpoint)
    migration: Migration = field(default_factory=Migration)

    def fingerprint(self) -> str:
        """sha256 of all settings but the passwords."""
        plain = dataclasses.asdict(self)
        for side in ("source", "target"):
            del plain[side]["password"]
        return hashlib.sha256(json.dumps(plain, sort_keys=True).encode()).hexdigest()


# Other names of options, options that nothing reads here, and those that must not be zero.
_RENAMED = {"parallel_writers": "write_ahead_writers", "trust_server_certificate": "trust_server_cert"}
INERT = ("max_partitions", "copy_buffer_rows", "upsert_batch_size", "upsert_parallel_tasks", "use_binary_copy")
_COUNTS = (
    "workers", "chunk_size", "max_partitions", "read_ahead_buffers", "write_ahead_writers", "parallel_readers", "max_mssql_connections",
    "max_pg_connections", "finalizer_concurrency", "copy_buffer_rows", "upsert_batch_size", "upsert_parallel_tasks",
)


def parse(text: str, form: str) -> Config:
    """Settings from YAML or JSON text; unknown options are errors, inert ones are told."""
    try:
        if form == "json":
            raw = json.loads(text)
        else:
            import yaml

            raw = yaml.safe_load(text)
    except Exception as e:
        raise ConfigError(f"cannot be read as {form}: {e}") from e
    if not isinstance(raw, dict):
        raise ConfigError("settings must be a mapping")
    sides = {}
    for name, kind in (("source", Endpoint), ("target", Endpoint), ("migration", Migration)):
        own = {_RENAMED.get(k, k): v for k, v in (raw.get(name) or {}).items()}
        known = {f.name for f in dataclasses.fields(kind)}
        if extra := set(own) - known:
            raise ConfigError(f"{name}: unknown {', '.join(sorted(extra))}")
        sides[name] = kind(**own)
    for option in INERT:
        if getattr(sides["migration"], option) is not None:
            warnings.warn(f"migration.{option} is ignored", stacklevel=2)
    return Config(**sides)


def load(path: str) -> Config:
    form = "json" if os.path.splitext(path)[1].lower() == ".json" else "yaml"
    try:
        with open(path, encoding="utf-8") as f:
            return validate(parse(f.read(), form))
    except OSError as e:
        raise ConfigError(str(e)) from e


def validate(config: Config) -> Config:
    from tidemark.plans.connect import kinds

    for name, side in (("source", config.source), ("target", config.target)):
        if side.kind() not in DIALECTS and side.kind() in kinds()[f"{name}s"]:
            continue
        for need in ("host", "database"):
            if not getattr(side, need):
                raise ConfigError(f"{name}.{need} is required")
        if not side.user and side.auth != "kerberos":
            raise ConfigError(f"{name}.user is required")
        if side.kind() not in DIALECTS:
            raise ConfigError(f"{name}.type {side.type!r} is not one of {', '.join(DIALECTS)}")
    place = [(s.host, s.port, s.database, s.schema, s.path) for s in (config.source, config.target)]
    if place[0] == place[1]:
        raise ConfigError("source and target are the same")
    if config.migration.target_mode not in ("drop_recreate", "upsert"):
        raise ConfigError(f"target_mode {config.migration.target_mode!r}")
    for name in _COUNTS:
        if getattr(config.migration, name) == 0:
            raise ConfigError(f"migration.{name} must be at least 1")
    if config.migration.reject_limit is not None and config.migration.reject_limit < 0:
        raise ConfigError("migration.reject_limit must be at least 0")
    if not all(isinstance(c, dict) and all(isinstance(t, str) for t in c.values()) for c in config.migration.convert.values()):
        raise ConfigError("migration.convert must give each table's columns a type")
    for option in ("include_tables", "exclude_tables"):
        for pattern in getattr(config.migration, option):
            if not re.fullmatch(r"[A-Za-z0-9_.*?]+", pattern):
                raise ConfigError(f"{option}: {pattern!r}")
    return config


def keeps(name: str, include: list[str], exclude: list[str]) -> bool:
    """Whether a table is wanted: patterns see its name after the last dot, in any case; excluding wins."""
    plain = name.rsplit(".", 1)[-1].lower()
    hit = lambda patterns: any(fnmatch.fnmatchcase(plain, p.lower()) for p in patterns)
    return not hit(exclude) and (not include or hit(include))


def glob_regex(pattern: str) -> str:
    """The pattern as a regular expression for SQL."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern.lower()) + "$"
