"""Near-duplicate vectors by comparison of tiles in PCA order.

1. Equal vectors are one vector with a number of copies.
2. Principal axes come from a bounded sample (``SAMPLE`` vectors; they only set the order of work). A tree of
   median splits on them deals vectors into leaves of about a tile's rows, or a leaf is salted into tiles.
   Tiles are as many as it takes to give each core ``CELLS`` pairs of tiles, and more where a tile would
   pass ``TILE_BYTES``. A vector is sent once for each tile that its own meets, so what is moved grows with
   the root of the number of cores until tiles are full, and in proportion to the number of tiles from there on.
3. Unit vectors with cosine c are sqrt(2 - 2c) apart, so leaves whose boxes lie farther apart are never
   compared. Every other pair of tiles meets in one cell.
4. In a cell blocks of ``BLOCK`` rows are compared, leading axes first, in single precision with room for its
   error. What the rest can add is at most the product of the two suffix norms; pairs that cannot reach the
   threshold are left at once, and the work stops when none remains. Survivors are decided on the original
   vectors in double precision.
5. A cell returns the number of links of each vector and a spanning forest, never its pairs.

Vectors are named by numbers given when they are written, mixed by a bijection, so no two share a name.

Cases: vectors that are null, zero or hold null or non-finite components link with nothing, and vectors
of different length do not link. Equal vectors link with each other, repeated rows included. Ties do not
occur: a cosine of exactly the threshold links. Extra columns do not matter, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import grouped, whole_groups
from tidemark.llm.graph import components
from tidemark.llm.vectors import dims, matrix, normed, sample, usable
from tidemark.scratch import keep

THRESHOLD = 0.9
SAMPLE = 4096
BOX = 8
STEP = 16
#: Pairs of tiles for each core, least rows of a tile, and most bytes of its vectors in double precision.
CELLS = 4
LEAST_TILE = 256
TILE_BYTES = 32 << 20
#: Rows of the blocks that are compared at once.
BLOCK = 2048
#: Share of a block's pairs from which the next axes are accumulated for the whole block.
DENSE = 0.02
#: Error of a single-precision product of unit vectors, for each term.
_ROUNDING = 2e-7


class Layout:
    """Axes of one vector length, and the median splits that deal vectors into leaves."""

    def __init__(self, points: np.ndarray, leaves: int):
        unit = normed(points)
        _, axes = np.linalg.eigh(unit.T @ unit)
        self.axes = np.ascontiguousarray(axes[:, ::-1])
        turned = unit @ self.axes
        self.depth = int(math.log2(max(leaves, 1)))
        self.axis = np.zeros(1 << self.depth, np.int64)
        self.cut = np.zeros(1 << self.depth)
        held = {1: np.arange(len(turned))}
        for level in range(self.depth):
            for node in range(1 << level, 2 << level):
                rows = held.pop(node, np.zeros(0, np.int64))
                if len(rows) > 1:
                    lead = turned[rows][:, : 4 * BOX]
                    self.axis[node] = int(np.argmax(lead.var(axis=0)))
                    self.cut[node] = float(np.median(lead[:, self.axis[node]]))
                side = turned[rows, self.axis[node]] > self.cut[node]
                held[2 * node], held[2 * node + 1] = rows[~side], rows[side]

    def turn(self, x: np.ndarray) -> np.ndarray:
        return normed(x) @ self.axes

    def leaf(self, turned: np.ndarray) -> np.ndarray:
        node = np.ones(len(turned), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (turned[np.arange(len(turned)), self.axis[node]] > self.cut[node])
        return node - (1 << self.depth)


class Side:
    """Vectors of one side of a cell: unit vectors, and their coordinates in steps of the leading axes.

    The product of step s of two sides takes the bound of the step before to the bound of this one: the
    coordinates' share of the cosine, plus the new product of suffix norms, less the old one.
    """

    def __init__(self, x: np.ndarray, layout: Layout):
        self.unit = normed(x)
        turned = self.unit @ layout.axes
        squares = np.cumsum((turned * turned)[:, ::-1], axis=1)[:, ::-1]
        self.left, self.right = [], []
        self.slack = _ROUNDING * 2 * (turned.shape[1] + STEP)
        before = None
        for at in range(0, turned.shape[1], STEP):
            end = at + STEP
            rest = np.sqrt(squares[:, end]) if end < turned.shape[1] else np.zeros(len(turned))
            extra = [rest] if before is None else [rest, before]
            minus = [rest] if before is None else [rest, -before]
            self.left.append(np.column_stack([turned[:, at:end], *extra]).astype(np.float32))
            self.right.append(np.column_stack([turned[:, at:end], *minus]).astype(np.float32))
            before = rest

    def __len__(self) -> int:
        return len(self.unit)


def hits(a: Side, b: Side, threshold: float, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a and b with at least that cosine, in blocks; of one ``same`` side only i < j."""
    for x in range(0, len(a), BLOCK):
        for y in range(x if same else 0, len(b), BLOCK):
            i, j = _block(a, b, slice(x, x + BLOCK), slice(y, y + BLOCK), threshold)
            i, j = i + x, j + y
            if same and x == y:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j


def _block(a: Side, b: Side, x: slice, y: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    bound, step = 0, 0
    for step, (left, right) in enumerate(zip(a.left, b.right, strict=True), 1):
        bound = bound + left[x] @ right[y].T if step > 1 else left[x] @ right[y].T
        able = bound >= threshold - a.slack
        count = np.count_nonzero(able)
        if not count:
            return none, none
        if count <= DENSE * able.size:
            break
    else:
        i, j = np.nonzero(a.unit[x] @ b.unit[y].T >= threshold)
        return i, j
    i, j = np.nonzero(able)
    bound = bound[able]
    for left, right in zip(a.left[step:], b.right[step:], strict=True):
        if len(i) <= 1024:
            break
        left, right = left[x], right[y]
        for at in range(0, len(i), 1 << 16):
            own = slice(at, at + (1 << 16))
            bound[own] += np.einsum("ij,ij->i", left[i[own]], right[j[own]])
        ok = bound >= threshold - a.slack
        i, j, bound = i[ok], j[ok], bound[ok]
    sure = np.zeros(len(i), bool)
    u, v = a.unit[x], b.unit[y]
    for at in range(0, len(i), 1 << 16):
        own = slice(at, at + (1 << 16))
        sure[own] = np.einsum("ij,ij->i", u[i[own]], v[j[own]]) >= threshold
    return i[sure], j[sure]


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the pairs (i, j) are linked: the least label of each group; a label's own label is itself."""
    while True:
        p, q = label[i], label[j]
        apart = p != q
        if not apart.any():
            return label
        i, j = i[apart], j[apart]
        low, high = np.minimum(p[apart], q[apart]), np.maximum(p[apart], q[apart])
        up = np.arange(len(label))
        np.minimum.at(up, high, low)
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


def tiling(rows: int, dim: int, cores: int) -> int:
    """Rows of a tile: n tiles make about n * n / 2 cells."""
    spread = -(-rows // math.ceil(math.sqrt(2 * CELLS * cores)))
    return max(1, min(max(spread, LEAST_TILE), TILE_BYTES // (8 * dim)))


def _cells(vectors: DataFrame, dim: int, rows: int, threshold: float) -> DataFrame:
    """(a, b, n): forest edges, and with b null the number of vectors linked to a."""
    spark = vectors.sparkSession
    tile = tiling(rows, dim, spark.sparkContext.defaultParallelism)
    layout = Layout(sample(vectors, "v", dim, rows, SAMPLE), min(rows // tile, SAMPLE // 16))
    shared = spark.sparkContext.broadcast(layout)

    def place(batches):
        for batch in batches:
            turned = shared.value.turn(matrix(batch.column("v"), dim))
            box = np.zeros((len(turned), BOX))
            box[:, : min(BOX, dim)] = turned[:, :BOX]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(box.ravel()), BOX).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("copies"), batch.column("v"), pa.array(shared.value.leaf(turned)), lists],
                names=["node", "copies", "v", "leaf", "box"],
            )

    kind = dict(vectors.dtypes)["v"]
    placed = vectors.filter(F.size("v") == dim).select("node", "copies", "v").mapInArrow(place, f"node long, copies long, v {kind}, leaf long, box array<double>")
    placed = keep(placed, "neardup-leaves")
    edges = [f(F.col("box")[i]).alias(f"{n}{i}") for i in range(BOX) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    leaves = sorted(placed.groupBy("leaf").agg(F.count("*").alias("n"), *edges).collect(), key=lambda r: r["leaf"])
    number = {r["leaf"]: i for i, r in enumerate(leaves)}
    # A leaf of a little more than a tile is one tile.
    tiles = np.array([-(-2 * r["n"] // (3 * tile)) for r in leaves])
    first = np.append(0, np.cumsum(tiles))
    lo = np.array([[r[f"lo{i}"] for i in range(BOX)] for r in leaves])
    hi = np.array([[r[f"hi{i}"] for i in range(BOX)] for r in leaves])
    most = 2 - 2 * threshold + 1e-6
    near: list[np.ndarray] = []
    for i in range(len(leaves)):
        gap = np.maximum(0, np.maximum(lo[i] - hi, lo - hi[i]))
        near.append(np.flatnonzero((gap * gap).sum(axis=1) <= most))
    plan = spark.sparkContext.broadcast((number, tiles, first, near))

    def deal(batches):
        for batch in batches:
            number, tiles, first, near = plan.value
            leaf = batch.column("leaf").to_numpy()
            node = batch.column("node").to_numpy()
            salt = (node.view(np.uint64) >> np.uint64(7)).astype(np.int64)
            take, cell, side = [], [], []
            for n in np.unique(leaf):
                rows = np.flatnonzero(leaf == n)
                i = number[int(n)]
                own = first[i] + salt[rows] % tiles[i]
                for j in near[i]:
                    for other in range(first[j], first[j + 1]):
                        take.append(rows)
                        cell.append(np.minimum(own, other) * first[-1] + np.maximum(own, other))
                        side.append(np.where(own == other, 0, np.where(own < other, 1, 2)))
                        if sum(map(len, take)) >= 20_000:
                            yield rows_of(batch, take, cell, side)
                            take, cell, side = [], [], []
            if take:
                yield rows_of(batch, take, cell, side)

    def rows_of(batch, take, cell, side):
        part = batch.take(pa.array(np.concatenate(take)))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(cell)), pa.array(np.concatenate(side)), part.column("node"), part.column("copies"), part.column("v")],
            names=["cell", "side", "node", "copies", "v"],
        )

    def compare(batches):
        for table in whole_groups(batches, "cell", 1):
            cells = table.column("cell").to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, cells[1:] != cells[:-1])), len(cells)).tolist()
            a, b, n = [], [], []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                part = table.slice(x, y - x)
                node, copies, side = (part.column(c).to_numpy() for c in ("node", "copies", "side"))
                v = matrix(part.column("v").combine_chunks(), dim)
                left, right = (np.arange(len(node)),) * 2 if side[0] == 0 else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
                if not len(left) or not len(right):
                    continue
                same = side[0] == 0
                one = Side(v[left], shared.value)
                label, degree = np.arange(len(node)), np.zeros(len(node), np.int64)
                for i, j in hits(one, one if same else Side(v[right], shared.value), threshold, same):
                    i, j = left[i], right[j]
                    degree += np.bincount(i, copies[j], minlength=len(node)).astype(np.int64)
                    degree += np.bincount(j, copies[i], minlength=len(node)).astype(np.int64)
                    label = merge(label, i, j)
                child = np.flatnonzero(label != np.arange(len(label)))
                some = np.flatnonzero(degree)
                a += [node[child], node[some]]
                b += [node[label[child]].tolist() + [None] * len(some)]
                n += [np.zeros(len(child), np.int64), degree[some]]
            if a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(a)), pa.array(sum(b, []), pa.int64()), pa.array(np.concatenate(n).astype(np.int64))], names=["a", "b", "n"]
                )

    dealt = placed.select("node", "copies", "v", "leaf").mapInArrow(deal, f"cell long, side long, node long, copies long, v {kind}")
    return grouped(dealt, "cell").mapInArrow(compare, "a long, b long, n long")


def classes(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    rows = df.select(F.col(ident).alias("vec_id"), F.col(vector).alias("v")).withColumn("ok", usable("v"))
    # 128 bits name a vector; rows without a usable one are spread by their ids and meet none.
    spread = F.xxhash64("vec_id", F.lit("none"))
    rows = rows.withColumn("h1", F.when(F.col("ok"), F.xxhash64("v")).otherwise(spread))
    rows = rows.withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit("2"), "v")))
    vectors = rows.filter("ok").groupBy("h1", "h2").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    # A number of 64 bits hashed alone keeps its own value, and links meet hashes in no order.
    vectors = keep(vectors.withColumn("number", F.monotonically_increasing_id()), "neardup-vectors").withColumn("node", F.xxhash64("number")).drop("number")
    found = None
    for dim, n in dims(vectors, "v"):
        part = _cells(vectors, dim, n, threshold)
        found = part if found is None else found.unionByName(part)
    narrow = rows.select("vec_id", "h1", "h2")
    if found is None:
        return narrow.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = keep(found, "neardup-links")
    linked = components(links.filter("b is not null").select("a", "b"))
    degree = links.filter("b is null").groupBy("a").agg(F.sum("n").alias("more"))
    own = vectors.select("h1", "h2", "node", "copies", "least")
    own = own.join(linked.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").withColumn("root", F.coalesce("root", "node"))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    own = own.join(least, "root").join(degree, F.col("node") == F.col("a"), "left")
    own = own.select("h1", "h2", "component_id", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    own = keep(own, "neardup-classes")
    component = F.when(F.col("n_links").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return narrow.join(own, ["h1", "h2"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
