"""Metadata that a DataFrame cannot carry: keys, references, checks, indexes and native types."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

KEY_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class ColumnMeta:
    name: str
    native: str
    length: int = 0
    precision: int = 0
    scale: int = 0
    nullable: bool = True
    identity: bool = False


@dataclass(frozen=True)
class ForeignKey:
    name: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"


@dataclass(frozen=True)
class Check:
    name: str
    definition: str


@dataclass(frozen=True)
class Index:
    name: str
    columns: tuple[str, ...]
    unique: bool = False
    included: tuple[str, ...] = ()


@dataclass(frozen=True)
class TableMeta:
    name: str
    columns: tuple[ColumnMeta, ...] = ()
    key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    checks: tuple[Check, ...] = ()
    indexes: tuple[Index, ...] = ()
    rows: int = 0
    schema: str = ""

    def column(self, name: str) -> ColumnMeta | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)


#: Spark types of the columns of a parquet table, by the native spelling of PostgreSQL.
_NATIVE = {"tinyint": "int2", "smallint": "int2", "int": "int4", "bigint": "int8", "float": "float4", "double": "float8", "string": "text", "boolean": "bool", "binary": "bytea", "date": "date", "timestamp": "timestamptz", "timestamp_ntz": "timestamp"}


def columns_of(df: DataFrame) -> tuple[ColumnMeta, ...]:
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if isinstance(f.dataType, T.DecimalType):
            out.append(ColumnMeta(f.name, "numeric", 0, f.dataType.precision, f.dataType.scale, f.nullable))
        elif isinstance(f.dataType, T.ArrayType):
            out.append(ColumnMeta(f.name, f"{_NATIVE.get(f.dataType.elementType.simpleString(), 'text')}[]", nullable=f.nullable))
        else:
            out.append(ColumnMeta(f.name, _NATIVE.get(kind, kind), nullable=f.nullable))
    return tuple(out)


def _fk(column: str, parent: str, parent_column: str) -> ForeignKey:
    return ForeignKey(f"fk_{column}", (column,), parent, (parent_column,))


#: Keys and references of the test tables (facts of the data; parquet does not hold them).
TABLES: dict[str, TableMeta] = {
    t.name: t
    for t in [
        TableMeta("region", key=("r_regionkey",)),
        TableMeta("nation", key=("n_nationkey",), foreign_keys=(_fk("n_regionkey", "region", "r_regionkey"),)),
        TableMeta("customer", key=("c_custkey",), foreign_keys=(_fk("c_nationkey", "nation", "n_nationkey"),)),
        TableMeta("supplier", key=("s_suppkey",), foreign_keys=(_fk("s_nationkey", "nation", "n_nationkey"),)),
        TableMeta("part", key=("p_partkey",)),
        TableMeta("orders", key=("o_orderkey",), foreign_keys=(_fk("o_custkey", "customer", "c_custkey"),)),
        TableMeta(
            "lineitem",
            foreign_keys=(_fk("l_orderkey", "orders", "o_orderkey"), _fk("l_partkey", "part", "p_partkey"), _fk("l_suppkey", "supplier", "s_suppkey")),
        ),
        TableMeta("events", key=("event_id",), foreign_keys=(_fk("user_id", "customer", "c_custkey"),)),
    ]
}


@dataclass(frozen=True)
class ParquetCatalog:
    """Tables of a folder of ``<name>.parquet``, with metadata by name."""

    spark: SparkSession
    root: str
    metadata: dict[str, TableMeta] = field(default_factory=lambda: TABLES)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def names(self) -> list[str]:
        """Table names in order, listed by the file system of the path."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        return sorted(n.removesuffix(".parquet") for n in (s.getPath().getName() for s in found) if n.endswith(".parquet"))

    def meta(self, name: str) -> TableMeta:
        known = self.metadata.get(name, TableMeta(name))
        return TableMeta(name, columns_of(self.table(name)), known.key, known.foreign_keys, known.checks, known.indexes, known.rows, known.schema)


def range_key(df: DataFrame, key: tuple[str, ...]) -> bool:
    """Whether ranges of the key can be read apart: one column of an integer type."""
    return len(key) == 1 and isinstance(df.schema[key[0]].dataType, KEY_TYPES)
