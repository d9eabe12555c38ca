"""SQL text for the three databases: selects, merges and table definitions."""

from __future__ import annotations

from tidemark.functions.idents import qualified, quote, referential_action, translate_check
from tidemark.functions.types import map_type
from tidemark.model import Check, ForeignKey, Index, TableMeta


def select(dialect: str, schema: str, table: str, columns: list[str], after: str | None = None, upto: str | None = None, key: str | None = None, where: str | None = None, limit: int | None = None, offset: int | None = None) -> str:
    """A page of a table; bounds are SQL literals."""
    names = ", ".join(quote(dialect, c) for c in columns)
    tests = [f"{quote(dialect, key)} > {after}"] * (after is not None) + [f"{quote(dialect, key)} <= {upto}"] * (upto is not None) + [f"({where})"] * bool(where)
    top = f"TOP ({limit}) " if dialect == "mssql" and limit is not None and offset is None else ""
    text = f"SELECT {top}{names} FROM {qualified(dialect, schema, table)}"
    if dialect == "mssql":
        text += " WITH (NOLOCK)"
    if tests:
        text += " WHERE " + " AND ".join(tests)
    if key:
        text += f" ORDER BY {quote(dialect, key)}"
    if limit is not None and not top:
        text += f" OFFSET {offset or 0} ROWS FETCH NEXT {limit} ROWS ONLY" if dialect == "mssql" else f" LIMIT {limit}" + (f" OFFSET {offset}" if offset else "")
    return text


def spatial(column) -> bool:
    return column.native.lower() in ("geometry", "geography", "point", "linestring", "polygon", "multipoint", "multilinestring", "multipolygon", "geometrycollection")


def as_text(dialect: str, name: str, table: TableMeta) -> str:
    """All columns of a table, spatial ones as WKT; PostgreSQL's own shapes, which ST_AsText does not know, as their text."""

    def part(c) -> str:
        q = quote(dialect, c.name)
        if not spatial(c):
            return q
        if dialect == "mssql":
            return f"{q}.STAsText() AS {q}"
        if dialect == "postgres" and c.native.lower() not in ("geometry", "geography"):
            return f"CAST({q} AS text) AS {q}"
        return f"ST_AsText({q}) AS {q}"

    return f"SELECT {', '.join(part(c) for c in table.columns)} FROM {name}"


# Types of a staging table that are wider than what Spark would choose, or that keep more of a value.
_STAGED = {
    "mssql": {"tinyint": "smallint", "timestamp": "datetime2(7)", "timestamp_ntz": "datetime2(7)", "string": "nvarchar(max)"},
    "mysql": {"timestamp": "datetime(6)", "timestamp_ntz": "datetime(6)", "string": "longtext"},
    "postgres": {"tinyint": "smallint"},
}


def create_staging(dialect: str, name: str, df, source: str = "postgres") -> str:
    """A staging table whose types take every value of the changes: one-byte integers as two, times with all their digits."""
    from tidemark.model import columns_of

    wide = {f.name: _STAGED.get(dialect, {}).get(f.dataType.simpleString()) for f in df.schema.fields}
    lines = [f"{quote(dialect, c.name)} {wide[c.name] or map_type(source, dialect, c.native, c.length, c.precision, c.scale, 'direct').target}" for c in columns_of(df)]
    return f"CREATE TABLE {name} ({', '.join(lines)})"


def merge(dialect: str, schema: str, table: str, staging: str, columns: list[str], keys: list[str]) -> str:
    """Staged rows into the table: insert or update, or insert only where all columns are keys."""
    q = [quote(dialect, c) for c in columns]
    rest = [quote(dialect, c) for c in columns if c not in keys]
    names, target, source = ", ".join(q), qualified(dialect, schema, table), qualified(dialect, "", staging)
    if dialect == "postgres":
        action = "DO UPDATE SET " + ", ".join(f"{c} = EXCLUDED.{c}" for c in rest) if rest else "DO NOTHING"
        return f"INSERT INTO {target} ({names}) SELECT {names} FROM {source} ON CONFLICT ({', '.join(quote(dialect, k) for k in keys)}) {action}"
    if dialect == "mysql":
        if not rest:
            return f"INSERT IGNORE INTO {target} ({names}) SELECT {names} FROM {source}"
        return f"INSERT INTO {target} ({names}) SELECT {names} FROM {source} ON DUPLICATE KEY UPDATE " + ", ".join(f"{c} = VALUES({c})" for c in rest)
    on = " AND ".join(f"t.{quote(dialect, k)} = s.{quote(dialect, k)}" for k in keys)
    text = f"MERGE INTO {target} WITH (TABLOCK) AS t USING {source} AS s ON {on}"
    if rest:
        differ = " OR ".join(f"t.{c} <> s.{c} OR (t.{c} IS NULL AND s.{c} IS NOT NULL) OR (t.{c} IS NOT NULL AND s.{c} IS NULL)" for c in rest)
        text += f" WHEN MATCHED AND ({differ}) THEN UPDATE SET " + ", ".join(f"t.{c} = s.{c}" for c in rest)
    return text + f" WHEN NOT MATCHED BY TARGET THEN INSERT ({names}) VALUES ({', '.join('s.' + c for c in q)});"


def partition_bounds(dialect: str, schema: str, table: str, key: str, parts: int) -> str:
    k = quote(dialect, key)
    inner = f"SELECT {k}, NTILE({parts}) OVER (ORDER BY {k}) AS partition_id FROM {qualified(dialect, schema, table)}"
    return f"SELECT partition_id, MIN({k}), MAX({k}), COUNT(*) FROM ({inner}) AS p GROUP BY partition_id ORDER BY partition_id"


def cut_points(dialect: str, schema: str, table: str, keys: list[str], rows: int) -> str:
    """Every ``rows``-th key in the database's own order, with its number."""
    names = ", ".join(quote(dialect, k) for k in keys)
    inner = f"SELECT {names}, ROW_NUMBER() OVER (ORDER BY {names}) AS row_no FROM {qualified(dialect, schema, table)}"
    return f"SELECT row_no, {names} FROM ({inner}) AS n WHERE row_no % {rows} = 0"


def row_slice(dialect: str, schema: str, table: str, columns: list[str], key: str, first: int, last: int) -> str:
    names, k = ", ".join(quote(dialect, c) for c in columns), quote(dialect, key)
    return f"SELECT {names} FROM (SELECT {names}, ROW_NUMBER() OVER (ORDER BY {k}) AS row_num FROM {qualified(dialect, schema, table)}) AS n WHERE row_num BETWEEN {first} AND {last}"


def create_table(source: str, dialect: str, table: TableMeta, schema: str, unlogged: bool = False, profile: str = "direct") -> str:
    lines = []
    for c in table.columns:
        kind = map_type(source, dialect, c.native, c.length, c.precision, c.scale, profile).target
        lines.append(f"{quote(dialect, c.name)} {kind}{'' if c.nullable and c.name not in table.key else ' NOT NULL'}")
    if dialect == "mssql" and table.key:
        lines.append(f"CONSTRAINT {quote(dialect, 'PK_' + table.name)} PRIMARY KEY CLUSTERED ({', '.join(quote(dialect, k) for k in table.key)})")
    word = "UNLOGGED TABLE" if unlogged and dialect == "postgres" else "TABLE"
    return f"CREATE {word} {qualified(dialect, schema, table.name)} ({', '.join(lines)})"


def create_schema(dialect: str, schema: str) -> str:
    if dialect == "mssql":
        name = schema.replace("'", "''")
        return f"IF NOT EXISTS (SELECT 1 FROM sys.schemas WHERE name = N'{name}') EXEC('CREATE SCHEMA {quote(dialect, schema)}')"
    return f"CREATE {'DATABASE' if dialect == 'mysql' else 'SCHEMA'} IF NOT EXISTS {quote(dialect, schema)}"


def drop_table(dialect: str, schema: str, table: str) -> str:
    return f"DROP TABLE IF EXISTS {qualified(dialect, schema, table)}" + (" CASCADE" if dialect == "postgres" else "")


def add_key(dialect: str, schema: str, table: TableMeta) -> str:
    return f"ALTER TABLE {qualified(dialect, schema, table.name)} ADD PRIMARY KEY ({', '.join(quote(dialect, k) for k in table.key)})"


def add_index(dialect: str, schema: str, table: TableMeta, index: Index) -> str:
    """MySQL indexes only the first 255 characters of long text."""

    def part(name: str) -> str:
        c = table.column(name)
        long = dialect == "mysql" and c is not None and any(x in c.native.lower() for x in ("text", "blob"))
        return quote(dialect, name) + ("(255)" if long else "")

    text = f"CREATE {'UNIQUE ' if index.unique else ''}INDEX {quote(dialect, index.name)} ON {qualified(dialect, schema, table.name)} ({', '.join(map(part, index.columns))})"
    return text + (f" INCLUDE ({', '.join(quote(dialect, c) for c in index.included)})" if index.included and dialect != "mysql" else "")


def add_reference(dialect: str, schema: str, table: str, key: ForeignKey) -> str:
    own, other = (", ".join(quote(dialect, c) for c in cols) for cols in (key.columns, key.parent_columns))
    return (
        f"ALTER TABLE {qualified(dialect, schema, table)} ADD CONSTRAINT {quote(dialect, key.name)} FOREIGN KEY ({own}) REFERENCES {qualified(dialect, schema, key.parent)} ({other})"
        f" ON DELETE {referential_action(key.on_delete, dialect)} ON UPDATE {referential_action(key.on_update, dialect)}"
    )


def add_check(dialect: str, schema: str, table: str, check: Check) -> str:
    return f"ALTER TABLE {qualified(dialect, schema, table)} ADD CONSTRAINT {quote(dialect, check.name)} CHECK {translate_check(check.definition, dialect)}"


def reset_sequence(dialect: str, schema: str, table: str, column: str, top: int | None) -> str | None:
    if dialect == "postgres":
        name = f"{schema}.{table}".replace("'", "''")
        return f"SELECT setval(pg_get_serial_sequence('{name}', '{column}'), {max(top or 1, 1)})"
    if dialect == "mysql":
        return f"ALTER TABLE {qualified(dialect, schema, table)} AUTO_INCREMENT = {(top or 0) + 1}"
    return None


def set_logged(dialect: str, schema: str, table: str, logged: bool) -> str | None:
    return f"ALTER TABLE {qualified(dialect, schema, table)} SET {'' if logged else 'UN'}LOGGED" if dialect == "postgres" else None
