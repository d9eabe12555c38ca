"""Named queries over the test tables, and the SQL each one must agree with."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import scratch
from tidemark.functions import convert, copybinary, tolerant, tuning, types
from tidemark.model import TABLES, ColumnMeta, ParquetCatalog, columns_of
from tidemark.operators import constraints, hashtree, merge, partition, preflight, scan, splits, verify
from tidemark.plans.config import glob_regex, keeps
from tidemark.scratch import keep
from tidemark.sources.files import VersionedTable
from tidemark.streaming import state as states

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
MARK = dt.datetime(2024, 1, 15)
ORDER_MARK = dt.datetime(1999, 1, 1)
KEYED = [t for t in TABLES.values() if t.key]
ALL = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def query(name: str, sql: str | None = None):
    def put(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- scans ----


@query("keyset_first_page", "SELECT * FROM orders WHERE o_orderkey >= 100 ORDER BY o_orderkey LIMIT 500")
def _(spark, d):
    return scan.keyset_page(_t(spark, d, "orders"), "o_orderkey", 500, start=100)


@query("keyset_next_page", "SELECT * FROM orders WHERE o_orderkey > 599 AND o_orderkey <= 900 ORDER BY o_orderkey LIMIT 500")
def _(spark, d):
    return scan.keyset_page(_t(spark, d, "orders"), "o_orderkey", 500, after=599, upper=900)


@query("keyset_bounded_range", "SELECT * FROM orders WHERE o_orderkey > 250 AND o_orderkey <= 4000")
def _(spark, d):
    return scan.key_range(_t(spark, d, "orders"), "o_orderkey", after=250, upper=4000)


@query("offset_page_composite", "SELECT * FROM conversations ORDER BY conv_id, turn LIMIT 50 OFFSET 30")
def _(spark, d):
    return scan.offset_page(_t(spark, d, "conversations"), ["conv_id", "turn"], 50, 30)


@query("full_scan_projection", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(spark, d):
    return _t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")


@query("where_pushdown", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 10 AND (o_orderstatus = 'F')")
def _(spark, d):
    return scan.key_range(_t(spark, d, "orders"), "o_orderkey", after=10).filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query(
    "row_number_slice",
    "SELECT p_partkey, p_name, CAST(row_num AS INTEGER) AS row_num FROM (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) AS row_num FROM part) WHERE row_num BETWEEN 21 AND 120",
)
def _(spark, d):
    return scan.row_slice(_t(spark, d, "part").select("p_partkey", "p_name"), ["p_partkey"], 21, 120)


@query("watermark_incremental", f"SELECT * FROM events WHERE ts > TIMESTAMP '{MARK}' OR ts IS NULL")
def _(spark, d):
    return scan.watermark_filter(_t(spark, d, "events"), "ts", MARK)


@query(
    "watermark_null_inclusive",
    f"SELECT event_id, stamp FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts END AS stamp FROM events) WHERE stamp > TIMESTAMP '{MARK}' OR stamp IS NULL",
)
def _(spark, d):
    stamped = _t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("ts")).alias("stamp"))
    return scan.watermark_filter(stamped, "stamp", MARK)


# ---- partitions ----

_NTILE = "SELECT CAST(b AS INTEGER) AS partition_id, min(k) AS min_key, max(k) AS max_key, count(*) AS row_count FROM (SELECT {k} AS k, ntile({n}) OVER (ORDER BY {k}) AS b FROM {t}) GROUP BY b"


@query("ntile_partition_bounds", _NTILE.format(k="o_orderkey", n=7, t="orders"))
def _(spark, d):
    return partition.ntile_bounds(_t(spark, d, "orders"), "o_orderkey", 7)


@query("ntile_partition_bounds_single", _NTILE.format(k="c_custkey", n=4, t="customer"))
def _(spark, d):
    return partition.ntile_bounds_single(_t(spark, d, "customer"), "c_custkey", 4)


_WIDTH = "WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders), r AS (SELECT i, lo, hi - lo + 1 AS w FROM b, range(0, 6) AS t(i))"


@query(
    "equal_width_ranges",
    f"{_WIDTH} SELECT CAST(i + 1 AS INTEGER) AS partition_id, CAST(lo + i * (w // 6) + least(i, w % 6) AS BIGINT) AS range_start, CAST(lo + (i + 1) * (w // 6) + least(i + 1, w % 6) AS BIGINT) AS range_end FROM r",
)
def _(spark, d):
    return partition.equal_width_ranges(_t(spark, d, "orders"), "o_orderkey", 6)


@query(
    "range_row_counts",
    "WITH b AS (SELECT min(doc_id) AS lo, max(doc_id) - min(doc_id) + 1 AS w FROM labels), r AS (SELECT i, lo + i * (w // 8) + least(i, w % 8) AS a, lo + (i + 1) * (w // 8) + least(i + 1, w % 8) AS b FROM b, range(0, 8) AS t(i) WHERE i < w)"
    " SELECT CAST(i + 1 AS INTEGER) AS partition_id, count(doc_id) AS row_count FROM r LEFT JOIN labels ON doc_id >= a AND doc_id < b GROUP BY i",
)
def _(spark, d):
    labels = _t(spark, d, "labels")
    low, high = labels.agg(F.min("doc_id"), F.max("doc_id")).first()
    return partition.range_row_counts(labels, "doc_id", partition.equal_width(low, high, 8))


# ---- counts and keys ----


@query("table_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ALL))
def _(spark, d):
    return verify.table_counts({n: _t(spark, d, n) for n in ALL})


@query("max_primary_keys", " UNION ALL ".join(f"SELECT '{t.name}' AS table_name, CAST(max({t.key[0]}) AS BIGINT) AS max_key FROM {t.name}" for t in KEYED))
def _(spark, d):
    parts = [_t(spark, d, t.name).agg(F.max(t.key[0]).cast("long").alias("max_key")).select(F.lit(t.name).alias("table_name"), "max_key") for t in KEYED]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("min_max_pk", "SELECT min(o_orderkey) AS min_key, max(o_orderkey) AS max_key, count(*) AS row_count FROM orders")
def _(spark, d):
    return _t(spark, d, "orders").agg(F.min("o_orderkey").alias("min_key"), F.max("o_orderkey").alias("max_key"), F.count("*").alias("row_count"))


@query("next_sequence_values", " UNION ALL ".join(f"SELECT '{t.name}' AS table_name, CAST(coalesce(max({t.key[0]}), 0) + 1 AS BIGINT) AS next_value FROM {t.name}" for t in KEYED))
def _(spark, d):
    parts = [constraints.next_sequence(_t(spark, d, t.name), t.key[0]).select(F.lit(t.name).alias("table_name"), "next_value") for t in KEYED]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- merges: orders below 9/10 of the keys is the target, above 1/2 the source, every seventh row changed ----

_SPLIT = "WITH n AS (SELECT max(o_orderkey) AS top FROM orders), t AS (SELECT orders.* FROM orders, n WHERE o_orderkey * 10 < top * 9), s AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders, n WHERE o_orderkey * 2 >= top)"


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    orders = _t(spark, d, "orders")
    top = orders.agg(F.max("o_orderkey")).first()[0]
    status = F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))
    target = orders.filter(F.col("o_orderkey") < F.lit(-(-top * 9 // 10)))
    return target, orders.filter(F.col("o_orderkey") >= F.lit(-(-top // 2))).withColumn("o_orderstatus", status)


_MERGED = "SELECT * FROM {s} UNION ALL SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {s})"


@query("upsert_full", f"{_SPLIT} {_MERGED.format(s='s')}")
def _(spark, d):
    return merge.upsert(*_sides(spark, d), ["o_orderkey"])


@query("upsert_incremental", f"{_SPLIT}, i AS (SELECT * FROM s WHERE o_orderdate > TIMESTAMP '{ORDER_MARK}' OR o_orderdate IS NULL) {_MERGED.format(s='i')}")
def _(spark, d):
    target, source = _sides(spark, d)
    return merge.upsert(target, scan.watermark_filter(source, "o_orderdate", ORDER_MARK), ["o_orderkey"])


@query(
    "upsert_null_overwrite",
    "WITH s AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0)"
    " SELECT * FROM s UNION ALL SELECT * FROM customer WHERE c_custkey % 2 <> 0",
)
def _(spark, d):
    customer = _t(spark, d, "customer")
    source = customer.filter("c_custkey % 2 = 0").withColumns({"c_acctbal": F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")), "c_mktsegment": F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))})
    return merge.upsert(customer, source, ["c_custkey"])


@query("upsert_pk_only", "SELECT n_nationkey FROM nation")
def _(spark, d):
    keys = _t(spark, d, "nation").select("n_nationkey")
    return merge.upsert(keys.filter("n_nationkey < 15"), keys.filter("n_nationkey >= 10"), ["n_nationkey"])


@query("upsert_composite_pk", "SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 AND conv_id % 3 = 0 THEN upper(role) ELSE text END AS text FROM conversations")
def _(spark, d):
    c = _t(spark, d, "conversations")
    return merge.upsert(c, c.filter("turn % 2 = 0 AND conv_id % 3 = 0").withColumn("text", F.upper("role")), ["conv_id", "turn"])


@query(
    "merge_change_actions",
    f"{_SPLIT} SELECT CASE WHEN s.o_orderkey IS NULL THEN 'keep' WHEN t.o_orderkey IS NULL THEN 'insert' WHEN s.o_orderstatus IS NOT DISTINCT FROM t.o_orderstatus THEN 'noop' ELSE 'update' END AS action, count(*) AS row_count FROM s FULL JOIN t ON s.o_orderkey = t.o_orderkey GROUP BY 1",
)
def _(spark, d):
    return merge.classify(*_sides(spark, d), ["o_orderkey"]).groupBy("action").agg(F.count("*").alias("row_count"))


@query("merge_noop_filtered", f"{_SPLIT} SELECT s.*, CASE WHEN t.o_orderkey IS NULL THEN 'insert' ELSE 'update' END AS action FROM s LEFT JOIN t ON s.o_orderkey = t.o_orderkey WHERE t.o_orderkey IS NULL OR s.o_orderstatus IS DISTINCT FROM t.o_orderstatus")
def _(spark, d):
    return merge.changed_rows(*_sides(spark, d), ["o_orderkey"])


_ITEM = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query(
    "dedupe_latest_by_key",
    f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in _ITEM)}) AS n FROM lineitem) WHERE n = 1",
)
def _(spark, d):
    return merge.dedupe_latest(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.desc(c) for c in _ITEM])


# ---- constraints ----


@query("pk_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return constraints.pk_duplicates(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def _orphans(child: str, column: str, parent: str, key: str, part: str):
    @query(f"fk_orphans_{child}_{column}", f"SELECT {column}, count(*) AS row_count FROM {child} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {parent} WHERE {part}) GROUP BY 1")
    def _(spark, d):
        bad = constraints.fk_orphans(_t(spark, d, child), [column], _t(spark, d, parent).filter(part), [key])
        return bad.groupBy(column).agg(F.count("*").alias("row_count"))


for _table in TABLES.values():
    for _f in _table.foreign_keys:
        _orphans(_table.name, _f.columns[0], _f.parent, _f.parent_columns[0], f"{_f.parent_columns[0]} % 4 <> 1")


@query(
    "null_violations",
    "SELECT 'c_acctbal' AS column_name, count(*) FILTER (c_custkey % 3 = 0) AS null_count FROM customer UNION ALL SELECT 'c_name', count(*) FILTER (c_name IS NULL) FROM customer",
)
def _(spark, d):
    c = _t(spark, d, "customer").withColumn("c_acctbal", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")))
    return constraints.null_violations(c, ["c_acctbal", "c_name"])


@query("check_violations", "SELECT o_orderkey, o_totalprice FROM orders WHERE NOT (o_totalprice > 100000 AND o_orderdate <= now())")
def _(spark, d):
    return constraints.check_violations(_t(spark, d, "orders"), "([o_totalprice] > 100000 AND [o_orderdate] <= getdate())").select("o_orderkey", "o_totalprice")


_EDGES = [(t.name, f.parent) for t in TABLES.values() for f in t.foreign_keys]


@query(
    "fk_dependency_levels",
    f"WITH RECURSIVE e(child, parent) AS (VALUES {', '.join(f'{e}' for e in _EDGES)}), l(name, level) AS (SELECT n, 0 FROM (VALUES {', '.join(f'({t!r})' for t in TABLES)}) AS t(n) UNION SELECT e.child, l.level + 1 FROM l JOIN e ON e.parent = l.name) SELECT name AS table_name, CAST(max(level) AS INTEGER) AS level FROM l GROUP BY name",
)
def _(spark, d):
    rows = [(n, i) for i, level in enumerate(constraints.fk_levels(list(TABLES.values()))) for n in level]
    return spark.createDataFrame(rows, "table_name string, level int")


# ---- state of runs that the events stand for: a day is a run, a type of event a table ----

_DAYS_SQL = (
    "WITH st AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, date_trunc('day', ts) AS run_started_at, event_type AS table_name, CASE WHEN count(*) % 3 = 0 THEN 'failed' ELSE 'completed' END AS table_status,"
    " count(*) AS rows_transferred, count(*) FILTER (value < 10) AS rows_skipped, CASE WHEN count(*) % 2 = 0 THEN min(ts) END AS last_sync_timestamp, max(ts) AS updated_at FROM events GROUP BY ALL)"
)


def _days(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp_ntz")
    runs = _t(spark, d, "events").groupBy(F.date_format(ts, "yyyy-MM-dd").alias("run_id"), F.date_trunc("day", ts).cast("timestamp_ntz").alias("run_started_at"), F.col("event_type").alias("table_name"))
    n = F.count("*")
    return runs.agg(
        F.when(n % 3 == 0, "failed").otherwise("completed").alias("table_status"),
        n.alias("rows_transferred"),
        F.count_if(F.col("value") < 10).alias("rows_skipped"),
        F.when(n % 2 == 0, F.min(ts)).alias("last_sync_timestamp"),
        F.max(ts).alias("updated_at"),
    )


@query("latest_run_of_events", f"{_DAYS_SQL} SELECT run_id, table_name, table_status FROM st WHERE run_id = (SELECT max(run_id) FROM st)")
def _(spark, d):
    return states.latest_run(_days(spark, d)).select("run_id", "table_name", "table_status")


@query("last_sync_of_events", f"{_DAYS_SQL} SELECT table_name, CAST(arg_max(last_sync_timestamp, updated_at) AS TIMESTAMP) AS last_sync_timestamp FROM st WHERE table_status = 'completed' AND last_sync_timestamp IS NOT NULL GROUP BY table_name")
def _(spark, d):
    return states.last_sync(_days(spark, d))


@query("pending_tables_of_events", f"{_DAYS_SQL}, days AS (SELECT DISTINCT run_id FROM st), names AS (SELECT DISTINCT table_name FROM st) SELECT table_name FROM names WHERE table_name NOT IN (SELECT table_name FROM st WHERE table_status = 'completed' AND run_id = (SELECT max(run_id) FROM days))")
def _(spark, d):
    state = _days(spark, d)
    return states.pending_tables(state.select("table_name").distinct(), states.latest_run(state), "upsert")


@query(
    "run_summary_of_events",
    f"{_DAYS_SQL} SELECT run_id, count(*) FILTER (table_status = 'completed') AS tables_success, count(*) FILTER (table_status = 'failed') AS tables_failed, CAST(coalesce(sum(rows_transferred) FILTER (table_status = 'completed'), 0) AS BIGINT) AS rows_transferred, CAST(coalesce(sum(rows_skipped) FILTER (table_status = 'completed'), 0) AS BIGINT) AS rows_skipped FROM st GROUP BY run_id",
)
def _(spark, d):
    return states.run_summary(_days(spark, d))


@query(
    "progress_of_orders",
    "SELECT o_orderpriority AS table_name, CAST(sum(o_custkey) AS BIGINT) AS row_count, count(*) AS partitions, arg_min('late ' || o_orderkey, o_orderkey) FILTER (o_custkey % 100 = 7) AS error FROM orders GROUP BY o_orderpriority",
)
def _(spark, d):
    late = F.when(F.col("o_custkey") % 100 == 7, F.concat(F.lit("late "), F.col("o_orderkey").cast("string")))
    return states.table_progress(_t(spark, d, "orders").select(F.col("o_orderpriority").alias("table_name"), F.col("o_orderkey").alias("partition_id"), F.col("o_custkey").alias("row_count"), late.alias("error")))


# The SQL says it another way: the least end that no range of the type leads beyond.
@query(
    "resume_points_of_events",
    "WITH r AS (SELECT event_type, CASE WHEN event_id >= 100 THEN event_id END AS a, event_id + 20 + event_id % 7 AS b FROM events)"
    " SELECT event_type, CASE WHEN bool_or(a IS NULL) THEN min(b) FILTER (NOT EXISTS (SELECT 1 FROM r AS o WHERE o.event_type = r.event_type AND (o.a IS NULL OR o.a <= r.b) AND o.b > r.b)) END AS resume_key FROM r GROUP BY event_type",
)
def _(spark, d):
    events = _t(spark, d, "events")
    start = F.when(F.col("event_id") >= 100, F.col("event_id"))
    return states.resume_point(events.select("event_type", start.alias("range_start"), (F.col("event_id") + 20 + F.col("event_id") % 7).alias("range_end")), by=["event_type"])


# ---- verification ----

_LESS = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 50 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 97 <> 3"
_WHOLE = "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders"
_COMPARED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


def _perturbed(spark, d) -> tuple[DataFrame, DataFrame]:
    source = _t(spark, d, "orders").select(*_COMPARED)
    status = F.when(F.col("o_orderkey") % 50 == 0, "Z").otherwise(F.col("o_orderstatus"))
    return source, source.filter("o_orderkey % 97 <> 3").withColumn("o_orderstatus", status)


@query(
    "count_reconciliation",
    "SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS source_count, (SELECT count(*) FROM orders WHERE o_orderkey % 97 <> 3) AS target_count, FALSE AS is_match"
    " UNION ALL SELECT 'nation', count(*), count(*), TRUE FROM nation UNION ALL SELECT 'part', count(*), NULL, FALSE FROM part",
)
def _(spark, d):
    source, target = _perturbed(spark, d)
    nation = _t(spark, d, "nation")
    return verify.reconcile(verify.table_counts({"orders": source, "nation": nation, "part": _t(spark, d, "part")}), verify.table_counts({"orders": target, "nation": nation}))


@query("bucket_count_diff", f"WITH s AS ({_WHOLE}), t AS ({_LESS}), a AS (SELECT o_orderkey // 500 AS bucket, count(*) AS n FROM s GROUP BY 1), b AS (SELECT o_orderkey // 500 AS bucket, count(*) AS n FROM t GROUP BY 1) SELECT a.bucket, a.n AS source_count, coalesce(b.n, 0) AS target_count FROM a LEFT JOIN b ON a.bucket = b.bucket WHERE a.n <> coalesce(b.n, 0)")
def _(spark, d):
    return verify.bucket_diff(*_perturbed(spark, d), "o_orderkey", 500)


_DIFF = f"WITH s AS ({_WHOLE}), t AS ({_LESS}) SELECT s.o_orderkey, CASE WHEN t.o_orderkey IS NULL THEN 'missing' ELSE 'different' END AS status FROM s LEFT JOIN t ON s.o_orderkey = t.o_orderkey WHERE t.o_orderkey IS NULL OR s.o_orderstatus IS DISTINCT FROM t.o_orderstatus"


@query("row_hash_diff", _DIFF)
def _(spark, d):
    return verify.hash_diff(*_perturbed(spark, d), ["o_orderkey"], _COMPARED)


@query("tiered_diff", _DIFF)
def _(spark, d):
    return verify.tiered(*_perturbed(spark, d), ["o_orderkey"], _COMPARED, 500)


@query("row_md5", "SELECT o_orderkey, md5(concat_ws('|', coalesce('v' || CAST(o_orderkey AS VARCHAR), 'n'), coalesce('v' || o_orderstatus, 'n'))) AS row_md5 FROM orders")
def _(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", verify.row_hash(["o_orderkey", "o_orderstatus"]).alias("row_md5"))


# ---- parts between cuts, merges in files, trees, frames, rejects ----


@query("rows_by_tuple_parts", "SELECT conv_id, turn, role, text FROM conversations")
def _(spark, d):
    """The table as eight scans between cut points of its composite key: each row once."""
    rows = _t(spark, d, "conversations")
    return _between_cuts(rows, ["conv_id", "turn"], 8)


@query("rows_by_text_parts", "SELECT p_partkey, p_name, p_type FROM part")
def _(spark, d):
    return _between_cuts(_t(spark, d, "part").select("p_partkey", "p_name", "p_type"), ["p_type", "p_name"], 5)


def _between_cuts(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    bounds = [None, *splits.cut_points(df, keys, parts), None]
    each = [splits.between(df, keys, a, b) for a, b in zip(bounds, bounds[1:], strict=False)]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


_TUPLES = "SELECT conv_id, turn, ntile(6) OVER (ORDER BY conv_id, turn) AS b FROM conversations"


@query(
    "tuple_partition_bounds",
    f"SELECT CAST(b AS INTEGER) AS partition_id, arg_min(conv_id, (conv_id, turn)) AS first_conv, arg_min(turn, (conv_id, turn)) AS first_turn, arg_max(conv_id, (conv_id, turn)) AS last_conv, arg_max(turn, (conv_id, turn)) AS last_turn, count(*) AS row_count FROM ({_TUPLES}) GROUP BY b",
)
def _(spark, d):
    keys = _t(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("key"))
    named = {"first_conv": "min_key.conv_id", "first_turn": "min_key.turn", "last_conv": "max_key.conv_id", "last_turn": "max_key.turn"}
    return partition.ntile_bounds(keys, "key", 6).select("partition_id", *[F.col(c).alias(n) for n, c in named.items()], "row_count")


# Nine keys of ten lie in a thousandth of the range.
_SKEWED = "SELECT CASE WHEN event_id % 10 > 0 THEN event_id ELSE event_id * 1000 END AS k FROM events"


@query("skewed_parts", f"SELECT CAST(b AS BIGINT) AS part, count(*) AS row_count, min(k) AS min_key, max(k) AS max_key FROM (SELECT k, ntile(12) OVER (ORDER BY k) AS b FROM ({_SKEWED})) GROUP BY b")
def _(spark, d):
    skewed = _t(spark, d, "events").select(F.when(F.col("event_id") % 10 > 0, F.col("event_id")).otherwise(F.col("event_id") * 1000).alias("k"))
    cuts = splits.cut_points(skewed, ["k"], 12, exact=True)
    return skewed.withColumn("part", hashtree.leaf_of(skewed, ["k"], cuts).cast("long") + 1).groupBy("part").agg(F.count("*").alias("row_count"), F.min("k").alias("min_key"), F.max("k").alias("max_key"))


def _aside(spark: SparkSession, name: str) -> VersionedTable:
    """A versioned table in the shared folder, of this run alone."""
    return VersionedTable(spark, f"{scratch.shared_root(spark)}/{name}-{uuid.uuid4().hex}")


@query(
    "merge_in_files",
    "SELECT o_orderkey, CASE WHEN o_orderkey BETWEEN 40 AND 60 OR o_orderkey % 1000 = 7 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders"
    " UNION ALL SELECT -1 - o_orderkey, 'N', o_totalprice FROM orders WHERE o_orderkey % 1000 = 7",
)
def _(spark, d):
    """Two merges into a table of files: the first puts it in key order, the second rewrites what its keys touch."""
    orders = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    table = _aside(spark, "merged-orders")
    table.file_rows = 1000
    table.publish(orders)
    table.merge(orders.filter("o_orderkey BETWEEN 40 AND 60").withColumn("o_orderstatus", F.lit("Z")), ["o_orderkey"])
    sparse = orders.filter("o_orderkey % 1000 = 7")
    fresh = sparse.select((-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), "o_totalprice")
    table.merge(sparse.withColumn("o_orderstatus", F.lit("Z")).unionByName(fresh), ["o_orderkey"])
    return table.read()


@query(
    "state_saved_twice",
    f"{_DAYS_SQL} SELECT run_id, table_name, CASE WHEN rows_transferred % 2 = 0 THEN 'completed' ELSE table_status END AS table_status, rows_transferred + CASE WHEN rows_transferred % 2 = 0 THEN 1 ELSE 0 END AS rows_transferred FROM st",
)
def _(spark, d):
    """Every run of the events is saved, then half of the rows again as they ended: earlier runs stay."""
    days = keep(_days(spark, d).select("run_id", "table_name", "table_status", "rows_transferred"), "days")
    store = _aside(spark, "state")
    store.publish(states.save(days.limit(0), days))
    again = days.filter("rows_transferred % 2 = 0").withColumns({"table_status": F.lit("completed"), "rows_transferred": F.col("rows_transferred") + 1})
    for _ in range(2):
        store.publish(states.save(store.read(), again))
    return store.read()


@query("hash_tree_diff", _DIFF)
def _(spark, d):
    return hashtree.tree_diff(*_perturbed(spark, d), ["o_orderkey"], _COMPARED, 500)


_LEAVES = "SELECT ntile(9) OVER (ORDER BY c_custkey) - 1 AS leaf, md5(concat_ws('|', 'v' || c_custkey, 'v' || c_name)) AS h FROM customer"


@query(
    "hash_tree_nodes",
    f"WITH r AS (SELECT leaf, count(*) AS n, sum(CAST(CAST('0x' || h[1:15] AS BIGINT) AS DECIMAL(38,0))) AS s FROM ({_LEAVES}) GROUP BY leaf), l0 AS (SELECT leaf AS node, n, md5(n || ':' || s) AS hash FROM r),"
    + ", ".join(f"l{i} AS (SELECT node // 4 AS node, CAST(sum(n) AS BIGINT) AS n, md5(string_agg(node || ':' || hash, ',' ORDER BY node)) AS hash FROM l{i - 1} GROUP BY node // 4)" for i in (1, 2))
    + " SELECT 0 AS level, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2",
)
def _(spark, d):
    customer = _t(spark, d, "customer")
    return hashtree.tree(customer, ["c_custkey"], ["c_custkey", "c_name"], splits.cut_points(customer, ["c_custkey"], 9, exact=True), 4)


def _field(value: str) -> str:
    """A value's bytes, given as hexadecimal digits, with their number before them."""
    return f"printf('%08x', length({value}) // 2) || lower({value})"


_FRAME = " || ".join(
    ["'0006'", *[_field(x) for x in ("printf('%016x', o_orderkey)", "printf('%016x', o_custkey)", "hex(encode(o_orderstatus))", "hex(CAST(CAST(o_totalprice AS BIT) AS BLOB))", "printf('%016x', CAST(epoch_us(o_orderdate) - 946684800000000 AS BIGINT))", "hex(encode(o_orderpriority))")]]
)


@query("binary_copy_frames", f"SELECT o_orderkey, md5(unhex({_FRAME})) AS frame_md5 FROM orders")
def _(spark, d):
    orders = _t(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    return orders.select("o_orderkey", F.md5(copybinary.frame(orders)).alias("frame_md5"))


@query("binary_copy_round_trip", "SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value, CASE WHEN event_id % 7 > 0 THEN props END AS props, CAST(value AS DECIMAL(12,4)) AS amount FROM events")
def _(spark, d):
    """Streams of the whole table, cut into chunks and read again."""
    events = _t(spark, d, "events").withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "props": F.when(F.col("event_id") % 7 > 0, F.col("props")), "amount": F.col("value").cast("decimal(12,4)")})
    return copybinary.read_chunks(copybinary.chunks(events), events.schema)


# A text of each event whose number does not fit a small integer, or is none: in one of nine it has a letter.
_TYPED = "SELECT event_id, CAST(user_id * 700 AS VARCHAR) || CASE WHEN event_id % 9 = 4 THEN 'x' ELSE '' END AS a, CASE WHEN event_id % 5 > 0 THEN regexp_extract(props, '[0-9]+') ELSE event_type END AS b FROM events"
_FITS = "TRY_CAST(a AS SMALLINT) IS NOT NULL AND (b IS NULL OR TRY_CAST(b AS INTEGER) IS NOT NULL)"


def _typed(spark: SparkSession, d: str) -> DataFrame:
    a = F.concat((F.col("user_id") * 700).cast("string"), F.when(F.col("event_id") % 9 == 4, "x").otherwise(""))
    b = F.when(F.col("event_id") % 5 > 0, F.regexp_extract("props", "[0-9]+", 0)).otherwise(F.col("event_type"))
    return _t(spark, d, "events").select("event_id", a.alias("a"), b.alias("b"))


@query("converted_rows", f"SELECT event_id, TRY_CAST(a AS SMALLINT) AS a, TRY_CAST(b AS INTEGER) AS b FROM ({_TYPED}) WHERE {_FITS}")
def _(spark, d):
    return tolerant.Conversion(_typed(spark, d), {"a": "smallint", "b": "int"}, ["event_id"]).good


@query(
    "rejected_values",
    f"SELECT event_id, 'a' AS column_name, a AS value FROM ({_TYPED}) WHERE TRY_CAST(a AS SMALLINT) IS NULL UNION ALL SELECT event_id, 'b', b FROM ({_TYPED}) WHERE TRY_CAST(b AS INTEGER) IS NULL",
)
def _(spark, d):
    return tolerant.Conversion(_typed(spark, d), {"a": "smallint", "b": "int"}, ["event_id"]).rejects


@query(
    "orphans_of_changes",
    "SELECT event_id, user_id FROM (SELECT event_id, CASE WHEN event_id % 50 = 3 THEN -user_id - 1 ELSE user_id END AS user_id FROM events WHERE event_id % 20 = 3) WHERE user_id NOT IN (SELECT c_custkey FROM customer)",
)
def _(spark, d):
    """Of changed events only; of the parents only the files that may hold a key they refer to."""
    customer = _t(spark, d, "customer")
    parents = _aside(spark, "parents")
    parents.file_rows = 500
    parents.publish(customer)
    parents.merge(customer.filter("c_custkey = 0"), ["c_custkey"])
    user = F.when(F.col("event_id") % 50 == 3, -F.col("user_id") - 1).otherwise(F.col("user_id"))
    changes = _t(spark, d, "events").filter("event_id % 20 = 3").select("event_id", user.alias("user_id"))
    return constraints.fk_orphans(changes, ["user_id"], parents.holding(changes, ["c_custkey"], ["user_id"]), ["c_custkey"])


# ---- names, types, values ----

_NAMES = ["dbo.Users", "dbo.UserLogs", "TempData", "log_2024", "dbo.Posts"]
_IN, _OUT = ["user*", "p?sts", "log*"], ["*logs"]


@query(
    "table_glob_filter",
    f"SELECT table_name FROM (VALUES {', '.join(f'({n!r})' for n in _NAMES)}) AS t(table_name) WHERE (" + " OR ".join(f"regexp_matches(lower(split_part(table_name, '.', -1)), '{glob_regex(p)}')" for p in _IN) + ") AND NOT (" + " OR ".join(f"regexp_matches(lower(split_part(table_name, '.', -1)), '{glob_regex(p)}')" for p in _OUT) + ")",
)
def _(spark, d):
    from tidemark.plans.config import keeps

    return spark.createDataFrame([(n,) for n in _NAMES if keeps(n, _IN, _OUT)], "table_name string")


# Types of each database with length, digits and scale, and what they become under the profile direct.
_TYPES = {
    ("mssql", "postgres"): [
        ("bit", 0, 0, 0, "boolean", False),
        ("tinyint", 0, 0, 0, "smallint", False),
        ("int", 0, 0, 0, "integer", False),
        ("decimal", 0, 10, 2, "numeric(10,2)", False),
        ("decimal", 0, 0, 0, "numeric", False),
        ("nvarchar", 100, 0, 0, "varchar(100)", False),
        ("nvarchar", -1, 0, 0, "text", False),
        ("datetime2", 0, 0, 0, "timestamp", False),
        ("datetimeoffset", 0, 0, 0, "timestamptz", False),
        ("uniqueidentifier", 0, 0, 0, "uuid", False),
        ("money", 0, 0, 0, "numeric(19,4)", False),
    ],
    ("postgres", "mssql"): [
        ("bool", 0, 0, 0, "bit", False),
        ("int4", 0, 0, 0, "int", False),
        ("numeric", 0, 10, 2, "decimal(10,2)", False),
        ("numeric", 0, 0, 0, "decimal(38,10)", False),
        ("varchar", 100, 0, 0, "nvarchar(100)", False),
        ("text", 0, 0, 0, "nvarchar(max)", False),
        ("date", 0, 0, 0, "datetime2", True),
        ("jsonb", 0, 0, 0, "nvarchar(max)", True),
        ("_int4", 0, 0, 0, "nvarchar(max)", True),
        ("uuid", 0, 0, 0, "uniqueidentifier", False),
        ("inet", 0, 0, 0, "varchar(50)", True),
    ],
    ("mysql", "postgres"): [
        ("tinyint", 1, 0, 0, "boolean", False),
        ("tinyint", 4, 0, 0, "smallint", False),
        ("json", 0, 0, 0, "jsonb", False),
        ("enum", 0, 0, 0, "text", True),
        ("year", 0, 0, 0, "smallint", False),
        ("bit", 8, 0, 0, "bit varying", False),
        ("longblob", 0, 0, 0, "bytea", False),
        ("double", 0, 0, 0, "double precision", False),
        ("varchar", 0, 0, 0, "text", False),
    ],
    ("postgres", "mysql"): [
        ("bool", 0, 0, 0, "TINYINT(1)", False),
        ("serial", 0, 0, 0, "INT AUTO_INCREMENT", False),
        ("numeric", 0, 70, 40, "DECIMAL(65,30)", True),
        ("timestamptz", 0, 0, 0, "DATETIME", True),
        ("uuid", 0, 0, 0, "VARCHAR(36)", True),
        ("jsonb", 0, 0, 0, "JSON", False),
        ("oid", 0, 0, 0, "BIGINT UNSIGNED", False),
        ("text", 0, 0, 0, "LONGTEXT", False),
        ("bytea", 0, 0, 0, "LONGBLOB", False),
    ],
    ("mysql", "mssql"): [
        ("tinyint", 1, 0, 0, "bit", False),
        ("decimal", 0, 50, 10, "decimal(38,10)", True),
        ("json", 0, 0, 0, "nvarchar(max)", True),
        ("varchar", 255, 0, 0, "nvarchar(255)", False),
        ("varbinary", 100, 0, 0, "varbinary(100)", False),
        ("set", 0, 0, 0, "nvarchar(max)", True),
        ("datetime", 0, 0, 0, "datetime2", False),
    ],
    ("mssql", "mysql"): [
        ("bit", 0, 0, 0, "TINYINT(1)", False),
        ("tinyint", 0, 0, 0, "TINYINT UNSIGNED", False),
        ("nvarchar", -1, 0, 0, "LONGTEXT", False),
        ("datetime2", 0, 0, 0, "DATETIME", False),
        ("uniqueidentifier", 0, 0, 0, "VARCHAR(36)", True),
        ("varbinary", -1, 0, 0, "LONGBLOB", False),
        ("xml", 0, 0, 0, "LONGTEXT", True),
    ],
    ("mssql", "mssql"): [
        ("int", 0, 0, 0, "int", False),
        ("nvarchar", 50, 0, 0, "nvarchar(50)", False),
        ("decimal", 0, 10, 2, "decimal(10,2)", False),
    ],
    ("postgres", "postgres"): [
        ("int4", 0, 0, 0, "int4", False),
        ("varchar", 50, 0, 0, "varchar(50)", False),
        ("jsonb", 0, 0, 0, "jsonb", False),
    ],
    ("mysql", "mysql"): [
        ("double", 0, 0, 0, "double", False),
        ("json", 0, 0, 0, "json", False),
        ("char", 10, 0, 0, "char(10)", False),
    ],
}


def _type_map(source: str, target: str, rows: list[tuple]) -> None:
    values = ", ".join(f"({n!r}, {length}, {p}, {s}, {t!r}, {lossy})" for n, length, p, s, t, lossy in rows)

    @query(f"type_map_{source}_{target}", f"SELECT native_type, CAST(length AS INTEGER) AS length, CAST(digits AS INTEGER) AS digits, CAST(scale AS INTEGER) AS scale, target_type, is_lossy FROM (VALUES {values}) AS t(native_type, length, digits, scale, target_type, is_lossy)")
    def _(spark, d):
        return types.mapping_table(spark, source, target, "direct", [r[:4] for r in rows])


for (_a, _b), _rows in _TYPES.items():
    _type_map(_a, _b, _rows)


@query("oversized_rows", "SELECT doc_id, 2 * length(text) + 2 * length(regexp_replace(text, '[\\x{0}-\\x{FFFF}]', '', 'g')) AS utf16_bytes FROM documents WHERE 2 * length(text) + 2 * length(regexp_replace(text, '[\\x{0}-\\x{FFFF}]', '', 'g')) > 65535")
def _(spark, d):
    docs = _t(spark, d, "documents")
    return convert.route_oversized(docs)[1].select("doc_id", convert.utf16_bytes(F.col("text")).alias("utf16_bytes"))


@query("utf16_sizes", "SELECT doc_id, 2 * length(text) + 2 * length(regexp_replace(text, '[\\x{0}-\\x{FFFF}]', '', 'g')) AS utf16_bytes FROM documents")
def _(spark, d):
    return _t(spark, d, "documents").select("doc_id", convert.utf16_bytes(F.col("text")).alias("utf16_bytes"))


_ESCAPED = "replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(9), chr(92) || 't'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r')"


@query("escape_tsv", f"SELECT doc_id, md5({_ESCAPED}) AS escaped_md5, length({_ESCAPED}) AS escaped_chars FROM documents")
def _(spark, d):
    e = convert.escape_tsv(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.md5(e).alias("escaped_md5"), F.length(e).cast("long").alias("escaped_chars"))


@query("escape_copy", f"SELECT page_id, md5({_ESCAPED.replace('text', 'html')}) AS escaped_md5 FROM pages")
def _(spark, d):
    return _t(spark, d, "pages").select("page_id", F.md5(convert.escape_copy(F.col("html"))).alias("escaped_md5"))


@query(
    "epoch2000_encode",
    "SELECT o_orderkey, CAST(datediff('day', DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days, epoch_us(o_orderdate) - 946684800000000 AS micros, CAST(CAST(epoch_us(o_orderdate) + 62135596800000000 AS HUGEINT) * 10 AS VARCHAR) AS ticks FROM orders",
)
def _(spark, d):
    c = F.col("o_orderdate")
    return _t(spark, d, "orders").select("o_orderkey", convert.days_since_2000(c).alias("days"), convert.micros_since_2000(c).alias("micros"), convert.ticks(c).cast("string").alias("ticks"))


@query("date_to_midnight", "SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS midnight, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS millis FROM events")
def _(spark, d):
    return _t(spark, d, "events").select("event_id", convert.midnight(F.col("ts")).alias("midnight"), convert.millis_text(F.col("ts")).alias("millis"))


@query("finite_values", "SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 1) THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer")
def _(spark, d):
    odd = F.when(F.col("c_custkey") % 5 == 0, float("nan")).when(F.col("c_custkey") % 5 == 1, float("-inf")).otherwise(F.col("c_acctbal"))
    return _t(spark, d, "customer").select("c_custkey", convert.finite(odd).alias("c_acctbal"))


@query("uuid_and_hex", "SELECT c_custkey, lower(hex(encode(c_name))) AS name_hex FROM customer")
def _(spark, d):
    return _t(spark, d, "customer").select("c_custkey", convert.hex_text(F.encode("c_name", "UTF-8")).alias("name_hex"))


@query("base10000_digits", "SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN '' WHEN o_orderkey < 10000 THEN CAST(o_orderkey AS VARCHAR) ELSE CAST(o_orderkey // 10000 AS VARCHAR) || ',' || CAST(o_orderkey % 10000 AS VARCHAR) END AS digits FROM orders")
def _(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", F.array_join(convert.base10000(F.col("o_orderkey")).cast("array<string>"), ",").alias("digits"))


_AMOUNTS = "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) - 250000 AS d FROM orders"


@query(
    "signed_base10000_digits",
    f"WITH a AS ({_AMOUNTS}), w AS (SELECT o_orderkey, d, CAST(floor(abs(d)) AS BIGINT) AS whole, CAST(abs(d) * 100 AS BIGINT) % 100 AS cents FROM a)"
    " SELECT o_orderkey, d < 0 AS negative, CAST(CASE WHEN whole = 0 THEN -1 WHEN whole < 10000 THEN 0 ELSE 1 END AS INTEGER) AS weight, concat_ws(',', CASE WHEN whole >= 10000 THEN whole // 10000 END, CASE WHEN whole > 0 THEN whole % 10000 END, cents * 100) AS digits, CAST(CAST(d AS DECIMAL(18,2)) AS VARCHAR) AS amount FROM w",
)
def _(spark, d):
    amount = F.col("o_totalprice").cast("decimal(18,2)") - 250000
    packed = _t(spark, d, "orders").select("o_orderkey", convert.signed_base10000(amount, 2).alias("p"))
    back = convert.decimal_text(F.col("p.digits"), F.col("p.weight"), F.col("p.negative"), F.col("p.scale"))
    return packed.select("o_orderkey", "p.negative", "p.weight", F.array_join(F.col("p.digits").cast("array<string>"), ",").alias("digits"), back.alias("amount"))


@query(
    "uuid_round_trip",
    "SELECT c_custkey, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS uuid, h AS bytes_hex FROM (SELECT c_custkey, md5(c_name) AS h FROM customer)",
)
def _(spark, d):
    named = _t(spark, d, "customer").select("c_custkey", convert.uuid_text(F.unhex(F.md5("c_name"))).alias("uuid"))
    return named.withColumn("bytes_hex", convert.hex_text(convert.uuid_bytes(F.col("uuid"))))


@query("packed_text_round_trip", "SELECT doc_id, strlen(text) AS n_bytes, md5(text) AS text_md5 FROM documents")
def _(spark, d):
    packed = convert.packed_texts(_t(spark, d, "documents").select("doc_id", "text"), "text")
    # The first four bytes are the size, the least significant one first.
    size = sum((F.conv(F.hex(F.substring("text", i + 1, 1)), 16, 10).cast("long") * 256**i for i in range(4)), F.lit(0))
    back = convert.unpacked_texts(packed.withColumn("n_bytes", size.cast("long")), "text")
    return back.select("doc_id", "n_bytes", F.md5("text").alias("text_md5"))


_SIZES = {"region": 104, "nation": 108, "customer": 220, "supplier": 120, "part": 320, "orders": 232, "lineitem": 268}


@query("row_size_estimates", " UNION ALL ".join(f"SELECT '{n}' AS table_name, CAST({b} AS BIGINT) AS row_bytes" for n, b in _SIZES.items()))
def _(spark, d):
    catalog = ParquetCatalog(spark, d)
    return spark.createDataFrame([(n, tuning.row_bytes(columns_of(catalog.table(n)))) for n in _SIZES], "table_name string, row_bytes long")


@query("avg_row_size", "SELECT CAST(sum(n * b) // sum(n) AS BIGINT) AS avg_row_bytes FROM (" + " UNION ALL ".join(f"SELECT count(*) AS n, {b} AS b FROM {n}" for n, b in _SIZES.items()) + ")")
def _(spark, d):
    counts = verify.table_counts({n: _t(spark, d, n) for n in _SIZES})
    sizes = F.create_map(*[F.lit(x) for n, b in _SIZES.items() for x in (n, b)])
    sized = counts.withColumn("b", sizes[F.col("table_name")])
    return sized.agg(F.expr("sum(row_count * b) div sum(row_count)").alias("avg_row_bytes"))


@query("fallback_batch_rows", "SELECT CAST(c AS INTEGER) AS columns, CAST(greatest(1, least(1000, 2100 // c)) AS INTEGER) AS rows FROM range(1, 41) AS t(c)")
def _(spark, d):
    return spark.createDataFrame([(c, tuning.fallback_batch_rows(c)) for c in range(1, 41)], "columns int, rows int")


@query("index_columns_by_table", "SELECT table_name, string_agg(c, ',' ORDER BY n) AS columns FROM (VALUES ('orders', 2, 'o_custkey'), ('orders', 1, 'o_orderdate'), ('part', 1, 'p_brand')) AS t(table_name, n, c) GROUP BY table_name")
def _(spark, d):
    rows = spark.createDataFrame([("orders", 2, "o_custkey"), ("orders", 1, "o_orderdate"), ("part", 1, "p_brand")], "table_name string, n int, c string")
    return rows.groupBy("table_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "c"))), lambda x: x["c"]), ",").alias("columns"))


@query("catalog_columns", " UNION ALL ".join(f"SELECT '{n}' AS table_name, column_name, CAST(ordinal AS INTEGER) AS ordinal FROM (SELECT column_name, row_number() OVER () AS ordinal FROM (DESCRIBE {n}))" for n in ("region", "orders", "events")))
def _(spark, d):
    rows = [(n, c, i + 1) for n in ("region", "orders", "events") for i, c in enumerate(_t(spark, d, n).columns)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal int")


# ---- what the target's types would refuse ----

_DOCUMENTS_OF_MSSQL = (ColumnMeta("doc_id", "bigint", nullable=False), ColumnMeta("text", "nvarchar", 4000), ColumnMeta("lang", "nchar", 2, nullable=False), ColumnMeta("source", "varchar", 4), ColumnMeta("n_chars", "tinyint"))
_EVENTS_OF_MYSQL = (
    ColumnMeta("event_id", "int"), ColumnMeta("ts", "datetime"), ColumnMeta("user_id", "tinyint"), ColumnMeta("event_type", "char", 5), ColumnMeta("value", "decimal", 0, 4, 1), ColumnMeta("props", "varchar", 12),
)
_LINES_OF_MSSQL = (
    ColumnMeta("l_orderkey", "smallint"), ColumnMeta("l_quantity", "decimal", 0, 3, 2), ColumnMeta("l_extendedprice", "decimal", 0, 6, 2), ColumnMeta("l_discount", "decimal", 0, 2, 2),
    ColumnMeta("l_returnflag", "nchar", 1), ColumnMeta("l_linestatus", "uniqueidentifier"), ColumnMeta("l_shipdate", "datetime2"),
)


def _fit_sql(table: str, columns: list[tuple[str, str, bool, str]]) -> str:
    """columns: name, type in the target, whether it loses, and when a value is refused."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{kind}' AS target_type, {lossy} AS is_lossy, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, CAST(count(*) FILTER (WHERE {bad}) AS BIGINT) AS n_refused FROM {table}" for c, kind, lossy, bad in columns
    )


@query(
    "types_refuse_documents_mysql",
    _fit_sql(
        "documents",
        [
            ("doc_id", "BIGINT", False, "doc_id IS NULL"),
            ("text", "VARCHAR(4000)", False, "length(text) > 4000"),
            ("lang", "CHAR(2)", False, "lang IS NULL OR length(lang) > 2"),
            ("source", "VARCHAR(4)", False, "length(source) > 4"),
            ("n_chars", "TINYINT UNSIGNED", False, "n_chars NOT BETWEEN 0 AND 255"),
        ],
    ),
)
def _(spark, d):
    return preflight.fit(_t(spark, d, "documents"), _DOCUMENTS_OF_MSSQL, "mssql", "mysql")


@query(
    "types_refuse_events_mssql",
    _fit_sql(
        "events",
        [
            ("event_id", "int", False, "event_id NOT BETWEEN -2147483648 AND 2147483647"),
            ("ts", "datetime2", False, "year(ts) NOT BETWEEN 1 AND 9999"),
            ("user_id", "tinyint", False, "user_id NOT BETWEEN 0 AND 255"),
            ("event_type", "nchar(5)", False, "length(event_type) > 5"),
            ("value", "decimal(4,1)", False, "value IS NOT NULL AND TRY_CAST(value AS DECIMAL(4,1)) IS NULL"),
            ("props", "nvarchar(12)", False, "length(props) + length(regexp_replace(props, '[\\x{0}-\\x{FFFF}]', '', 'g')) > 12"),
        ],
    ),
)
def _(spark, d):
    return preflight.fit(_t(spark, d, "events"), _EVENTS_OF_MYSQL, "mysql", "mssql")


@query(
    "types_refuse_lineitem_postgres",
    _fit_sql(
        "lineitem",
        [
            ("l_orderkey", "smallint", False, "l_orderkey NOT BETWEEN -32768 AND 32767"),
            ("l_quantity", "numeric(3,2)", False, "l_quantity >= 9.995"),
            ("l_extendedprice", "numeric(6,2)", False, "l_extendedprice >= 9999.995"),
            ("l_discount", "numeric(2,2)", False, "l_discount >= 0.995"),
            ("l_returnflag", "char(1)", False, "length(l_returnflag) > 1"),
            ("l_linestatus", "uuid", False, "l_linestatus IS NOT NULL"),
            ("l_shipdate", "timestamp", False, "false"),
        ],
    ),
)
def _(spark, d):
    return preflight.fit(_t(spark, d, "lineitem"), _LINES_OF_MSSQL, "mssql", "postgres")


@query(
    "refused_documents_mysql",
    "SELECT * FROM (SELECT doc_id, concat_ws(',', CASE WHEN doc_id IS NULL THEN 'doc_id' END, CASE WHEN length(text) > 4000 THEN 'text' END, CASE WHEN lang IS NULL OR length(lang) > 2 THEN 'lang' END,"
    " CASE WHEN length(source) > 4 THEN 'source' END, CASE WHEN n_chars NOT BETWEEN 0 AND 255 THEN 'n_chars' END) AS refused FROM documents) WHERE refused <> ''",
)
def _(spark, d):
    rows = preflight.refused_rows(_t(spark, d, "documents"), _DOCUMENTS_OF_MSSQL, "mssql", "mysql")
    return rows.select("doc_id", F.array_join("refused_columns", ",").alias("refused"))


# ---- what a run does with the given tables ----

# Columns of each table, as facts of the data.
_WIDTHS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}


@query(
    "insert_batches_by_table",
    "SELECT table_name, CAST(n_columns AS INTEGER) AS n_columns, row_count, CAST(ceil(row_count / least(1000, 2100 // n_columns)) AS BIGINT) AS mssql_batches, CAST(ceil(row_count / (65535 // n_columns)) AS BIGINT) AS mysql_batches FROM ("
    + " UNION ALL ".join(f"SELECT '{t}' AS table_name, {n} AS n_columns, count(*) AS row_count FROM {t}" for t, n in _WIDTHS.items())
    + ")",
)
def _(spark, d):
    """Statements that plain inserts of each table take in two databases."""
    tables = {t: _t(spark, d, t) for t in ALL}
    widths = {t: len(df.columns) for t, df in tables.items()}
    of_table = lambda f: F.create_map(*[F.lit(x) for t, n in widths.items() for x in (t, f(n))])[F.col("table_name")]
    batches = lambda f: F.ceil(F.col("row_count") / of_table(f)).alias
    return verify.table_counts(tables).select("table_name", of_table(int).alias("n_columns"), "row_count", batches(tuning.fallback_batch_rows)("mssql_batches"), batches(tuning.mysql_batch_rows)("mysql_batches"))


@query("kept_table_rows", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ("orders", "events", "documents", "labels", "part", "region")))
def _(spark, d):
    """Rows of the tables that a run with these filters takes."""
    names = [t for t in ParquetCatalog(spark, d).names() if keeps(t, ["*s", "p?rt", "REG*"], ["conv*", "page?", "embeddings"])]
    return verify.table_counts({t: _t(spark, d, t) for t in names})


@query(
    "marks_by_table",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, max({c}) AS mark, count(*) - count({c}) AS n_nulls FROM {t}" for t, c in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate"))),
)
def _(spark, d):
    """The column that marks changes in each table that has one, its greatest value, and the rows without."""
    return scan.marks({t: _t(spark, d, t) for t in ALL}, ["updated_at", "TS", "o_orderdate", "l_shipdate", "value"])


@query(
    "load_levels",
    " UNION ALL ".join(
        f"SELECT CAST({level} AS INTEGER) AS load_level, '{t}' AS table_name, count(*) AS row_count FROM {t}"
        for level, names in enumerate((("part", "region"), ("nation",), ("customer", "supplier"), ("events", "orders"), ("lineitem",)))
        for t in names
    ),
)
def _(spark, d):
    """In which order the tables are given their references, and the rows that each level holds."""
    levels = constraints.fk_levels(list(TABLES.values()))
    level = F.create_map(*[F.lit(x) for i, names in enumerate(levels) for t in names for x in (t, i)])[F.col("table_name")]
    return verify.table_counts({t: _t(spark, d, t) for t in TABLES}).select(level.alias("load_level"), "table_name", "row_count")


@query("ordered_lines_by_order", "SELECT l_orderkey, string_agg(l_partkey || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    """An order has few lines, so its text is short."""
    lines = _t(spark, d, "lineitem").withColumn("part", F.concat_ws(":", "l_partkey", "l_suppkey"))
    return scan.ordered_texts(lines, ["l_orderkey"], "part", ["l_linenumber", "l_partkey", "l_suppkey"], "parts")
