"""Column types: native spellings, one canonical form, and back, with a note of what is lost.

A mapping goes native -> canonical -> native. The profile ``direct`` lays its own rules for some pairs over
that; everything it does not name comes from the canonical route.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DIALECTS = ("mssql", "postgres", "mysql")
ALIASES = {"sqlserver": "mssql", "pg": "postgres", "postgresql": "postgres", "mariadb": "mysql"}


@dataclass(frozen=True)
class Canonical:
    kind: str
    length: int = 0
    scale: int = 0
    inner: "Canonical | None" = None
    values: tuple[str, ...] = ()
    name: str = ""
    lossy: bool = False


@dataclass(frozen=True)
class Mapping:
    target: str
    lossy: bool = False
    warning: str | None = None


# Native spellings of each dialect by the kind that they are read as.
_SPELLINGS = {
    "mssql": {
        "Boolean": ("bit",),
        "UInt8": ("tinyint",),
        "Int16": ("smallint",),
        "Int32": ("int", "integer"),
        "Int64": ("bigint",),
        "Decimal": ("decimal", "numeric"),
        "Money": ("money",),
        "SmallMoney": ("smallmoney",),
        "Float64": ("float",),
        "Float32": ("real",),
        "Char": ("char", "nchar"),
        "Varchar": ("varchar", "nvarchar"),
        "Text": ("text", "ntext"),
        "Binary": ("binary",),
        "Varbinary": ("varbinary",),
        "Blob": ("image",),
        "Date": ("date",),
        "Time": ("time",),
        "DateTime": ("datetime", "datetime2", "smalldatetime"),
        "DateTimeTz": ("datetimeoffset",),
        "Uuid": ("uniqueidentifier",),
        "Xml": ("xml",),
        "Geometry": ("geometry",),
        "Geography": ("geography",),
    },
    "postgres": {
        "Boolean": ("bool", "boolean"),
        "Int16": ("int2", "smallint", "smallserial"),
        "Int32": ("int4", "integer", "int", "serial"),
        "Int64": ("int8", "bigint", "bigserial", "oid"),
        "Float32": ("float4", "real"),
        "Float64": ("float8", "double precision"),
        "Decimal": ("numeric", "decimal"),
        "Money": ("money",),
        "Char": ("char", "character", "bpchar"),
        "Varchar": ("varchar", "character varying", "name"),
        "Text": ("text",),
        "Blob": ("bytea",),
        "Date": ("date",),
        "Time": ("time", "time without time zone", "timetz", "time with time zone"),
        "DateTime": ("timestamp", "timestamp without time zone"),
        "DateTimeTz": ("timestamptz", "timestamp with time zone"),
        "Interval": ("interval",),
        "Uuid": ("uuid",),
        "Json": ("json",),
        "JsonBinary": ("jsonb",),
        "Xml": ("xml",),
        "Bit": ("bit",),
        "VarBit": ("varbit", "bit varying"),
        "InetAddr": ("inet",),
        "CidrAddr": ("cidr",),
        "MacAddr": ("macaddr", "macaddr8"),
        "Point": ("point",),
        "Line": ("line", "lseg"),
        "Polygon": ("box", "path", "polygon", "circle"),
        "TsVector": ("tsvector",),
        "TsQuery": ("tsquery",),
        "Int4Range": ("int4range",),
        "Int8Range": ("int8range",),
        "NumRange": ("numrange",),
        "TsRange": ("tsrange",),
        "TsTzRange": ("tstzrange",),
        "DateRange": ("daterange",),
    },
    "mysql": {
        "Boolean": ("bool", "boolean"),
        "Int16": ("tinyint", "smallint"),
        "Int32": ("mediumint", "int", "integer"),
        "Int64": ("bigint",),
        "Float32": ("float",),
        "Float64": ("double", "double precision", "real"),
        "Decimal": ("decimal", "numeric", "dec", "fixed"),
        "Char": ("char",),
        "Varchar": ("varchar",),
        "Text": ("tinytext", "text", "mediumtext", "longtext"),
        "Binary": ("binary",),
        "Varbinary": ("varbinary",),
        "Blob": ("tinyblob", "blob", "mediumblob", "longblob"),
        "Date": ("date",),
        "Time": ("time",),
        "DateTime": ("datetime", "timestamp"),
        "Year": ("year",),
        "Json": ("json",),
        "Bit": ("bit",),
        "Enum": ("enum",),
        "Set": ("set",),
        "Geometry": ("geometry", "point", "linestring", "polygon", "multipoint", "multilinestring", "multipolygon", "geometrycollection"),
    },
}
# Spellings whose kind does not hold all of the type.
_PARTLY = {
    "mssql": ("geometry", "geography"),
    "postgres": ("timetz", "time with time zone", "jsonb"),
    "mysql": ("enum", "set", "geometry", "point", "linestring", "polygon", "multipoint", "multilinestring", "multipolygon", "geometrycollection"),
}

# The type of each kind in SQL Server, PostgreSQL, MySQL and Spark.
_TARGETS = {
    "Boolean": ("bit", "boolean", "TINYINT(1)", "boolean"),
    "UInt8": ("tinyint", "smallint", "TINYINT UNSIGNED", "smallint"),
    "Int16": ("smallint", "smallint", "SMALLINT", "smallint"),
    "Int32": ("int", "integer", "INT", "int"),
    "Int64": ("bigint", "bigint", "BIGINT", "bigint"),
    "Float32": ("real", "real", "FLOAT", "float"),
    "Float64": ("float", "double precision", "DOUBLE", "double"),
    "Money": ("money", "numeric(19,4)", "DECIMAL(19,4)", "decimal(19,4)"),
    "SmallMoney": ("smallmoney", "numeric(10,4)", "DECIMAL(10,4)", "decimal(10,4)"),
    "Text": ("nvarchar(max)", "text", "LONGTEXT", "string"),
    "Blob": ("varbinary(max)", "bytea", "LONGBLOB", "binary"),
    "Date": ("date", "date", "DATE", "date"),
    "Time": ("time", "time", "TIME", "bigint"),
    "DateTime": ("datetime2", "timestamp", "DATETIME", "timestamp_ntz"),
    "DateTimeTz": ("datetimeoffset", "timestamptz", "DATETIME", "timestamp"),
    "Interval": ("nvarchar(100)", "interval", "VARCHAR(100)", "string"),
    "Year": ("smallint", "smallint", "YEAR", "smallint"),
    "Uuid": ("uniqueidentifier", "uuid", "VARCHAR(36)", "string"),
    "Json": ("nvarchar(max)", "json", "JSON", "string"),
    "JsonBinary": ("nvarchar(max)", "jsonb", "JSON", "string"),
    "Xml": ("xml", "xml", "LONGTEXT", "string"),
    "InetAddr": ("varchar(50)", "inet", "VARCHAR(50)", "string"),
    "CidrAddr": ("varchar(50)", "cidr", "VARCHAR(50)", "string"),
    "MacAddr": ("char(17)", "macaddr", "CHAR(17)", "string"),
    "Point": ("nvarchar(max)", "point", "TEXT", "string"),
    "Line": ("nvarchar(max)", "line", "TEXT", "string"),
    "Polygon": ("nvarchar(max)", "polygon", "TEXT", "string"),
    "Geometry": ("nvarchar(max)", "text", "TEXT", "string"),
    "Geography": ("nvarchar(max)", "text", "TEXT", "string"),
    "TsVector": ("nvarchar(max)", "tsvector", "LONGTEXT", "string"),
    "TsQuery": ("nvarchar(max)", "tsquery", "LONGTEXT", "string"),
    "Int4Range": ("nvarchar(100)", "int4range", "VARCHAR(100)", "string"),
    "Int8Range": ("nvarchar(100)", "int8range", "VARCHAR(100)", "string"),
    "NumRange": ("nvarchar(100)", "numrange", "VARCHAR(100)", "string"),
    "TsRange": ("nvarchar(100)", "tsrange", "VARCHAR(100)", "string"),
    "TsTzRange": ("nvarchar(100)", "tstzrange", "VARCHAR(100)", "string"),
    "DateRange": ("nvarchar(100)", "daterange", "VARCHAR(100)", "string"),
    "Enum": ("nvarchar(255)", "text", "TEXT", "string"),
    "Set": ("nvarchar(max)", "text", "TEXT", "string"),
    "Unknown": ("nvarchar(max)", "text", "LONGTEXT", "string"),
}
# Kinds of which the type there loses something.
_LOSSY = {
    "mssql": ("Interval", "Json", "JsonBinary", "InetAddr", "CidrAddr", "MacAddr", "Point", "Line", "Polygon", "Geometry", "Geography", "TsVector", "TsQuery", "Int4Range", "Int8Range", "NumRange", "TsRange", "TsTzRange", "DateRange", "Enum", "Set", "Unknown"),
    "postgres": ("Geometry", "Geography", "Enum", "Set", "Unknown"),
    "mysql": ("DateTimeTz", "Interval", "Uuid", "Xml", "InetAddr", "CidrAddr", "MacAddr", "Point", "Line", "Polygon", "Geometry", "Geography", "TsVector", "TsQuery", "Int4Range", "Int8Range", "NumRange", "TsRange", "TsTzRange", "DateRange", "Enum", "Set", "Unknown"),
    "spark": ("Interval", "Unknown"),
}

# Sized kinds, as (most length, form up to it, form beyond it); None: a length does not occur.
_SIZED = {
    ("Char", "mssql"): (4000, "nchar({n})", "nvarchar(max)"),
    ("Char", "postgres"): (10485760, "char({n})", "text"),
    ("Char", "mysql"): (255, "CHAR({n})", "TEXT"),
    ("Varchar", "mssql"): (4000, "nvarchar({n})", "nvarchar(max)"),
    ("Varchar", "postgres"): (10485760, "varchar({n})", "text"),
    ("Varchar", "mysql"): (65535, "VARCHAR({n})", "LONGTEXT"),
    ("Binary", "mssql"): (8000, "binary({n})", "varbinary(max)"),
    ("Binary", "postgres"): (0, "bytea", "bytea"),
    ("Binary", "mysql"): (255, "BINARY({n})", "BLOB"),
    ("Varbinary", "mssql"): (8000, "varbinary({n})", "varbinary(max)"),
    ("Varbinary", "postgres"): (0, "bytea", "bytea"),
    ("Varbinary", "mysql"): (65535, "VARBINARY({n})", "LONGBLOB"),
    ("VarBit", "mssql"): (0, "varbinary(max)", "varbinary(max)"),
    ("VarBit", "postgres"): (1 << 31, "bit varying({n})", "bit varying"),
    ("VarBit", "mysql"): (0, "BLOB", "BLOB"),
}
_MOST_DIGITS = {"mssql": 38, "mysql": 65, "postgres": 1 << 30, "spark": 38}
_DECIMAL = {"mssql": "decimal({p},{s})", "postgres": "numeric({p},{s})", "mysql": "DECIMAL({p},{s})", "spark": "decimal({p},{s})"}
# Lengths and digits where the source gives none.
_DEFAULT_DIGITS = {"mssql": 18, "postgres": 38, "mysql": 10}
_DEFAULT_LENGTH = {"Char": 1, "Binary": 1, "Bit": 1, "Varchar": 255, "Varbinary": 255, "VarBit": 0}

# Rules of the direct profile that differ from the canonical route: spellings, when, type, whether it loses. When: always, or
# no length (len0), a length (sized), no precision (p0), more than one bit (bits), more than 64 (long). "?" stands for any other spelling.
_DIRECT = {
    ("mssql", "postgres"): [
        (("decimal", "numeric"), "p0", "numeric", False),
        (("char", "nchar", "varchar", "nvarchar"), "len0", "text", False),
        (("geometry", "geography", "?"), "always", "text", False),
    ],
    ("postgres", "mssql"): [
        (("numeric", "decimal"), "p0", "decimal(38,10)", False),
        (("char", "character", "bpchar"), "len0", "nvarchar(max)", False),
        (("name",), "always", "nvarchar(128)", False),
        (("date",), "always", "datetime2", True),
        (("timetz", "time with time zone"), "always", "datetimeoffset", True),
    ],
    ("mysql", "postgres"): [
        (("decimal", "numeric", "dec", "fixed"), "p0", "numeric", False),
        (("char", "varchar"), "len0", "text", False),
        (("json",), "always", "jsonb", False),
        (("bit",), "bits", "bit varying", False),
        (("bit",), "long", "bytea", False),
    ],
    ("postgres", "mysql"): [
        (("numeric", "decimal"), "p0", "DECIMAL(10,0)", False),
        (("char", "character", "bpchar"), "len0", "TEXT", False),
        (("serial",), "always", "INT AUTO_INCREMENT", False),
        (("bigserial",), "always", "BIGINT AUTO_INCREMENT", False),
        (("smallserial",), "always", "SMALLINT AUTO_INCREMENT", False),
        (("oid",), "always", "BIGINT UNSIGNED", False),
        (("jsonb",), "always", "JSON", False),
    ],
    ("mysql", "mssql"): [
        (("tinyint",), "always", "tinyint", False),
        (("decimal", "numeric", "dec", "fixed"), "p0", "decimal(18,0)", False),
        (("char", "varchar"), "len0", "nvarchar(max)", False),
        (("binary", "varbinary"), "len0", "varbinary(max)", False),
        (("binary", "varbinary"), "sized", "varbinary({n})", False),
    ],
    ("mssql", "mysql"): [
        (("decimal", "numeric"), "p0", "DECIMAL(10,0)", False),
        (("char", "nchar"), "len0", "TEXT", False),
        (("varchar", "nvarchar"), "len0", "LONGTEXT", False),
        (("binary", "varbinary", "image"), "len0", "LONGBLOB", False),
        (("binary", "varbinary", "image"), "sized", "VARBINARY({n})", False),
    ],
}
#: Longest value for which a sized direct rule holds; beyond it the length counts as none.
_DIRECT_MOST = {"mssql": 8000, "mysql": 65535, "postgres": 10485760}


_KINDS = {d: {name: (kind, name in _PARTLY[d]) for kind, names in kinds.items() for name in names} for d, kinds in _SPELLINGS.items()}
KINDS = sorted({*_TARGETS, "Decimal", "Array", *(k for k, _ in _SIZED), "Bit"})


def dialect(name: str) -> str:
    name = ALIASES.get(name.lower(), name.lower())
    if name not in DIALECTS:
        raise ValueError(f"unknown database {name!r}")
    return name


def to_canonical(source: str, native: str, length: int = 0, precision: int = 0, scale: int = 0) -> Canonical:
    source, name = dialect(source), native.strip().lower()
    if source == "postgres" and (name.endswith("[]") or name.startswith("_")):
        inner = to_canonical(source, name.removesuffix("[]").removeprefix("_"), length, precision, scale)
        return Canonical("Array", inner=inner, lossy=inner.lossy)
    if source == "mysql" and name.split("(")[0] == "tinyint" and (length == 1 or "(1)" in name):
        return Canonical("Boolean")
    kind, lossy = _KINDS[source].get(name, ("Unknown", True))
    if kind == "Unknown":
        return Canonical("Unknown", name=native, lossy=True)
    if kind == "Decimal":
        return Canonical("Decimal", precision if precision > 0 else _DEFAULT_DIGITS[source], scale)
    if kind in ("Varchar", "Varbinary") and length == -1:
        return Canonical("Text" if kind == "Varchar" else "Blob")
    if name == "name" and source == "postgres":
        return Canonical("Varchar", 63)
    if kind in _DEFAULT_LENGTH:
        none = 0 if source == "postgres" and kind == "Varchar" else _DEFAULT_LENGTH[kind]
        n = length if length > 0 else none
        return Canonical("Boolean") if kind == "Bit" and source == "mysql" and n == 1 else Canonical(kind, n)
    return Canonical(kind, lossy=lossy)


def from_canonical(target: str, c: Canonical) -> Mapping:
    """The type of ``target``, which may also be ``spark``."""
    if target != "spark":
        target = dialect(target)
    if c.kind == "Array":
        if target in ("postgres", "spark"):
            inner = from_canonical(target, c.inner)
            return Mapping(f"{inner.target}[]" if target == "postgres" else f"array<{inner.target}>", inner.lossy, inner.warning)
        return Mapping("nvarchar(max)" if target == "mssql" else "JSON", True, "array kept as JSON text")
    if c.kind == "Decimal":
        most = _MOST_DIGITS[target]
        p = min(c.length, most)
        form = _DECIMAL[target].format(p=p, s=min(c.scale, 30 if target == "mysql" and c.length > most else p))
        return Mapping(form, c.length > most, f"{c.length} digits are more than {most}" if c.length > most else None)
    if c.kind in ("Enum", "Set") and c.values and target == "mysql":
        values = ",".join("'" + v.replace("'", "''") + "'" for v in c.values)
        return Mapping(f"{c.kind.upper()}({values})")
    if c.kind == "Bit":
        forms = {"mssql": "bit" if c.length == 1 else f"binary({-(-c.length // 8)})", "postgres": "boolean" if c.length == 1 else f"bit({c.length})", "mysql": f"BIT({c.length})" if c.length <= 64 else "BLOB", "spark": "boolean" if c.length == 1 else "binary"}
        return Mapping(forms[target])
    if (c.kind, "mssql") in _SIZED:
        if target == "spark":
            return Mapping("string" if c.kind in ("Char", "Varchar") else "binary")
        most, form, beyond = _SIZED[c.kind, target]
        return Mapping(form.format(n=c.length) if 0 < c.length <= most else beyond)
    form, lossy = _TARGETS[c.kind][(*DIALECTS, "spark").index(target)], c.kind in _LOSSY[target]
    return Mapping(form, lossy, f"{c.name or c.kind} kept as {form}" if lossy else None)


def _direct(source: str, target: str, native: str, length: int, precision: int) -> Mapping | None:
    name, unknown = native.strip().lower(), native.strip().lower() not in _KINDS[source]
    if name == "tinyint" and length == 1 and source == "mysql":
        return None
    most = _DIRECT_MOST[target]
    for wanted, when, form, lossy in _DIRECT.get((source, target), ()):
        if name not in wanted and not (unknown and "?" in wanted):
            continue
        none = length <= 0 or length > most
        if {"always": True, "len0": none, "sized": not none, "p0": precision <= 0, "bits": 1 < length <= 64, "long": length > 64}[when]:
            return Mapping(form.format(n=length), lossy, f"{native} kept as {form}" if lossy else None)
    return None


def map_type(source: str, target: str, native: str, length: int = 0, precision: int = 0, scale: int = 0, profile: str = "canonical") -> Mapping:
    source = dialect(source)
    if target != "spark":
        target = dialect(target)
    if source == target:
        return Mapping(spell(native, length, precision, scale))
    if profile == "direct" and (found := _direct(source, target, native, length, precision)):
        return found
    c = to_canonical(source, native, length, precision, scale)
    out = from_canonical(target, c)
    notes = [x for x in (f"{native} is read as {c.kind}" if c.lossy else None, out.warning) if x]
    return Mapping(out.target, c.lossy or out.lossy, " ".join(notes) or None)


#: Kinds whose spelling takes a length, and those that take digits.
_WITH_LENGTH = {"Char", "Varchar", "Binary", "Varbinary", "Bit", "VarBit"}


def spell(native: str, length: int = 0, precision: int = 0, scale: int = 0) -> str:
    """The type as written in a table of the same database, with its length or digits."""
    kinds = {t.get(native.lower(), ("", False))[0] for t in _KINDS.values()}
    if "(" in native or native.lower() == "name":
        return native
    if "Decimal" in kinds and precision > 0:
        return f"{native}({precision},{scale})"
    if kinds & _WITH_LENGTH and length == -1:
        return f"{native}(max)"
    if kinds & _WITH_LENGTH and length > 0:
        return f"{native}({length})"
    return native


def spark_type(source: str, native: str, length: int = 0, precision: int = 0, scale: int = 0) -> T.DataType:
    return T.DataType.fromDDL(map_type(source, "spark", native, length, precision, scale).target)


def mapping_table(spark: SparkSession, source: str, target: str, profile: str = "canonical", columns: list[tuple[str, int, int, int]] | None = None) -> DataFrame:
    """native_type, length, digits, scale, target_type and is_lossy of the given or of all spellings."""
    columns = columns or [(n, 0, 0, 0) for n in sorted(_KINDS[dialect(source)])]
    rows = [(n, l, p, s, m.target, m.lossy) for n, l, p, s in columns for m in [map_type(source, target, n, l, p, s, profile)]]
    return spark.createDataFrame(rows, "native_type string, length int, digits int, scale int, target_type string, is_lossy boolean")
