"""Comparing two copies of a table by trees of hashes: only leaves that differ are compared row by row.

The leaves of a tree lie between cut points of the key with equally many rows between, so skewed keys make leaves of one size. A
leaf's hash sums the hashes of its rows; a node's is that of its children's. A tree is one pass over a table and a row for each
node; it can be kept and compared later without the table. Two trees over the same cut points are compared from the root down:
of each level only the children of nodes that differ are looked at. The rows of leaves that differ are read by ranges of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.splits import between, cut_points
from tidemark.operators.verify import hash_diff, row_hash

#: Rows of a leaf, about, and children of a node.
LEAF_ROWS = 10_000
FANOUT = 16
#: Leaves of the largest tree: its cut points stand in the plan. Larger tables have larger leaves.
LEAVES = 1 << 16
#: Ranges that are read one by one; more are read in one scan.
SPANS = 64


def leaf_of(df: DataFrame, keys: list[str], cuts: list) -> Column:
    """The number of a row's leaf, from 0: a binary search among the cut points, which are one literal array."""
    kinds = [df.schema[k].dataType for k in keys]
    one = lambda values: F.struct(*[c.alias(f"k{i}") for i, c in enumerate(values)])
    points = F.array(*[one([F.lit(v).cast(t) for v, t in zip(cut, kinds, strict=True)]) for cut in cuts])
    key = one([F.col(k) for k in keys])
    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        done = s["low"] >= s["high"]
        right = ~done & (key > F.get(points, middle))
        return F.struct(F.when(right, middle + 1).otherwise(s["low"]).alias("low"), F.when(done | right, s["high"]).otherwise(middle).alias("high"))

    steps = F.array(*[F.lit(i) for i in range(max(1, len(cuts).bit_length()))])
    return F.aggregate(steps, start, halve)["low"] if cuts else F.lit(0)


def leaves(df: DataFrame, keys: list[str], columns: list[str], cuts: list) -> DataFrame:
    """(leaf, n, hash): rows of each leaf and the sum of what their md5 begin with (60 bits)."""
    print_ = F.conv(F.substring(row_hash(columns), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(leaf_of(df, keys, cuts).cast("long").alias("leaf")).agg(F.count("*").alias("n"), F.sum(print_).alias("hash"))


def tree(df: DataFrame, keys: list[str], columns: list[str], cuts: list, fanout: int = FANOUT) -> DataFrame:
    """(level, node, n, hash), level 0 being the leaves; a node has the rows and the md5 of the leaves below it."""
    level = leaves(df, keys, columns, cuts).select("leaf", "n", F.md5(F.concat_ws(":", "n", "hash").cast("binary")).alias("hash"))
    level = level.select(F.lit(0).alias("level"), F.col("leaf").alias("node"), "n", "hash")
    out, width, depth = level, len(cuts) + 1, 0
    while width > 1:
        depth, width = depth + 1, -(-width // fanout)
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))
        text = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["node"], c["hash"])), ",")
        level = level.groupBy(F.floor(F.col("node") / fanout).alias("node")).agg(F.sum("n").alias("n"), F.md5(text.cast("binary")).alias("hash"))
        level = level.select(F.lit(depth).alias("level"), "node", "n", "hash")
        out = out.unionByName(level)
    return out


def differing_leaves(a: DataFrame, b: DataFrame, cuts: list, fanout: int = FANOUT) -> list[int]:
    """Leaves in which two trees over the same cut points differ. Each level looks at children of differing nodes only."""
    depth, width = 0, len(cuts) + 1
    while width > 1:
        depth, width = depth + 1, -(-width // fanout)
    left = [0]
    for level in range(depth, -1, -1):
        own = [t.filter((F.col("level") == level) & F.col("node").isin(left)).select("node", F.struct("n", "hash").alias(x)) for t, x in ((a, "a"), (b, "b"))]
        apart = sorted(r["node"] for r in own[0].join(own[1], "node", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("node").collect())
        if level == 0:
            return apart
        left = [n * fanout + i for n in apart for i in range(fanout)]
        if not left:
            return []
    return []


def rows_of_leaves(df: DataFrame, keys: list[str], cuts: list, numbers: list[int]) -> DataFrame:
    """The rows of these leaves, neighbours as one range; each range's first key column reaches the scan."""
    bounds = [None, *cuts, None]
    spans: list[list[int]] = []
    for i in numbers:
        if spans and spans[-1][1] == i:
            spans[-1][1] = i + 1
        else:
            spans.append([i, i + 1])
    if len(spans) > SPANS:
        return df.filter(leaf_of(df, keys, cuts).isin(numbers))
    out = df.limit(0)
    for k, (x, y) in enumerate(spans):
        part = between(df, keys, bounds[x], bounds[y])
        out = part if k == 0 else out.unionByName(part)
    return out


def tree_diff(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str], leaf_rows: int = LEAF_ROWS, kept: tuple[DataFrame, list] | None = None) -> DataFrame:
    """Keys whose rows are missing, extra or different. ``kept``: the target's tree and its cut points from an earlier pass."""
    from tidemark.scratch import keep

    n = source.count()
    cuts = kept[1] if kept else cut_points(source, keys, min(LEAVES, max(1, -(-n // leaf_rows))), n)
    a = keep(tree(source, keys, columns, cuts), "tree")
    b = kept[0] if kept else keep(tree(target, keys, columns, cuts), "tree")
    apart = differing_leaves(a, b, cuts)
    return hash_diff(rows_of_leaves(source, keys, cuts, apart), rows_of_leaves(target, keys, cuts, apart), keys, columns)
