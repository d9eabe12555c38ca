"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import tempfile
import time

from pyspark.sql import functions as F

from tidemark.plans import catalog
from tidemark.session import local_session
from tidemark.sources.files import VersionedTable

HEADLINE = [
    "keyset_first_page", "keyset_bounded_range", "offset_page_composite", "full_scan_projection", "row_number_slice", "watermark_incremental",
    "watermark_null_inclusive", "ntile_partition_bounds", "equal_width_ranges", "range_row_counts", "table_row_counts", "min_max_pk", "upsert_full",
    "upsert_incremental", "upsert_null_overwrite", "upsert_composite_pk", "merge_change_actions", "merge_noop_filtered", "dedupe_latest_by_key",
    "pk_duplicate_keys", "fk_orphans_lineitem_l_orderkey", "check_violations", "count_reconciliation", "bucket_count_diff", "row_hash_diff", "tiered_diff",
    "row_md5", "utf16_sizes", "escape_tsv", "epoch2000_encode",
]
#: Timed apart, once each, so that the total stays that of the same queries.
MORE = [
    "rows_by_tuple_parts", "tuple_partition_bounds", "merge_in_files", "hash_tree_diff", "binary_copy_frames", "binary_copy_round_trip", "converted_rows",
    "rejected_values", "orphans_of_changes",
]


#: Rows that are written for the throughput of copies and merges.
WRITTEN = 10_000_000


def written(spark, sf_dir: str, rows: int = WRITTEN) -> dict[str, int]:
    """Rows a second of a whole copy and of a merge of every row, both written and published."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = orders.count()
    times = -(-rows // n)
    copies = orders.crossJoin(F.broadcast(spark.range(times).withColumnRenamed("id", "copy")))
    many = copies.withColumn("o_orderkey", F.col("o_orderkey").cast("long") * times + F.col("copy")).drop("copy")
    out = {}
    with tempfile.TemporaryDirectory(prefix="tidemark-bench-") as root:
        source, target = (VersionedTable(spark, f"file://{root}/{x}") for x in ("source", "target"))
        target.file_rows = 100_000
        source.publish(many)
        began = time.perf_counter()
        count = target.publish(source.read())
        out["drop_recreate_rows_per_sec"] = int(count / (time.perf_counter() - began))
        began = time.perf_counter()
        count = target.merge(source.read().withColumn("o_totalprice", F.col("o_totalprice") + 1), ["o_orderkey"])
        out["upsert_written_rows_per_sec"] = int(count / (time.perf_counter() - began))
        out["written_rows"] = count
        # Changes of a thousandth of the rows, next to each other, into a table in key order.
        target.merge(target.read().limit(1), ["o_orderkey"])  # the first small merge puts the table in key order
        before = set(target._folders(target.version()))
        low = n * times // 2
        few = target.read().filter((F.col("o_orderkey") >= low) & (F.col("o_orderkey") < low + count // 1000))
        began = time.perf_counter()
        changed = target.merge(few.withColumn("o_totalprice", F.col("o_totalprice") + 1), ["o_orderkey"])
        out["small_merge_sec"] = round(time.perf_counter() - began, 3)
        files = {f for f in target._folders(target.version()) if not f.startswith("index-")}
        out["small_merge_rows"], out["small_merge_files_written"], out["small_merge_files"] = changed, len(files - before), len(files)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries = catalog.queries()
    warm = queries["full_scan_projection"](spark, sf_dir)
    warm.write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        times[name] = round(best, 4)
    more = {}
    for name in MORE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        more[name] = round(time.perf_counter() - began, 4)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    found = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(found[1]) if found else None}
    out["more_queries"] = more
    out["upsert_rows_per_sec"] = int(orders / times["upsert_full"])
    out |= written(spark, sf_dir)
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
