"""Approximate nearest neighbours with balanced posting lists.

Centroids come from k-means on a bounded sample (``SAMPLE`` vectors), and clusters that hold much more than
their share of it are split until none does. Every vector is put on the list of its nearest centroid and,
if it lies near a boundary, on up to ``REPLICAS`` - 1 more lists whose centroid is at most ``CLOSURE`` times as
far. The centroids form a graph of near neighbours in memory; a best-first walk finds the centroids
near a query, and lists stay while their centroid is at most ``RATIO`` times as far as the nearest. How many
the walk may find grows with the number of lists: vectors without structure have theirs on ever more of them.
Lists longer than ``LIST_ROWS`` are dealt into parts, so a vector that a third of the rows repeat does not
make one task long, and the queries of a list that many ask are dealt too. All rows of a chosen list are compared,
in double precision. Lists are chosen among vectors that are centred and scaled by the sample, so that neither a far origin nor
huge or tiny components blur them; scores are of the original vectors.

Cases: vectors that are null, zero or hold null or non-finite components take no part, as query or as
candidate. Vectors of another length than the query's are no candidates. Rows equal in id and
vector count as one, and the query's own row is no candidate of it. Ties go to the smaller id. With no
usable query the result is empty. Extra columns do not matter.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import grouped, scatter, whole_groups
from tidemark.llm.vectors import dims, matrix, sample, usable
from tidemark.scratch import keep

NEIGHBOURS = 10
EVERY = 100
SAMPLE = 20_000
#: Rows of a list on average, and most centroids.
LIST_MEAN = 256
CENTROIDS = 4096
LIST_ROWS = 1024
REPLICAS = 4
CLOSURE = 1.1
RATIO = 1.35
DEGREE = 16
#: Queries of a list that one task compares, and how many at once.
LIST_ASKS, BLOCK = 4096, 32
#: Lists a query may read: ``SPREAD`` times the square root of their number, but not under ``WALK``.
WALK = 48
SPREAD = 4


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared, by the expanded form: for choosing lists, not for results."""
    return np.maximum(0, (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None, :])


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of x from those of q; where squares leave the range of doubles they are scaled first."""
    off = x[None, :, :] - q[:, None, :]
    with np.errstate(over="ignore", under="ignore"):
        out = np.sqrt((off * off).sum(axis=2))
        odd = ~np.isfinite(out) | (out < 1e-140)
        if odd.any():
            most = np.abs(off[odd]).max(axis=1)
            safe = np.where((most > 0) & np.isfinite(most), most, 1.0)
            part = off[odd] / safe[:, None]
            out[odd] = np.where(np.isfinite(most), safe * np.sqrt((part * part).sum(axis=1)), np.inf)
    return out


def kmeans(x: np.ndarray, k: int, turns: int = 8) -> np.ndarray:
    rng = np.random.default_rng(7)
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    centres = x[rng.permutation(len(x))[:k]]
    for _ in range(turns):
        near = np.concatenate([distances(x[i : i + 4096], centres).argmin(axis=1) for i in range(0, len(x), 4096)])
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


class Index:
    """Centroids and their graph."""

    def __init__(self, points: np.ndarray, k: int):
        # Halves first: a sum of huge components would leave the range of doubles.
        self.shift = (points / max(len(points), 1)).sum(axis=0)
        size = np.abs(points * 0.5 - self.shift * 0.5).max(initial=0.0)
        self.power = -int(np.frexp(size)[1]) if size > 0 and np.isfinite(size) else 0
        points = self.placed(points)
        centres = kmeans(points, k)
        share = 2 * len(points) / max(len(centres), 1)
        for _ in range(4):
            near = np.concatenate([distances(points[i : i + 4096], centres).argmin(axis=1) for i in range(0, len(points), 4096)])
            big = [c for c, n in enumerate(np.bincount(near, minlength=len(centres))) if n > share]
            parts = [kmeans(points[near == c], int(np.ceil((near == c).sum() / share)) + 1) for c in big]
            if not any(len(p) > 1 for p in parts):
                break
            stay = [c for c in range(len(centres)) if c not in set(big)]
            centres = np.concatenate([centres[stay], *parts])
        self.centres = centres
        d = distances(centres, centres)
        self.graph = np.argsort(d, axis=1, kind="stable")[:, 1 : DEGREE + 1]
        # A few distant entries make every region reachable.
        entries = [0]
        for _ in range(min(8, len(centres)) - 1):
            entries.append(int(d[entries].min(axis=0).argmax()))
        self.entries = entries

    def placed(self, x: np.ndarray) -> np.ndarray:
        """Vectors around the sample's mean, by a power of two about as large as one."""
        return np.ldexp(x * 0.5 - self.shift * 0.5, self.power)

    def walk(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroids near q and their distances, nearest first."""
        width, q = max(WALK, math.ceil(SPREAD * math.sqrt(len(self.centres)))), self.placed(q)

        def far(nodes):
            return np.sqrt(((self.centres[nodes] - q) ** 2).sum(axis=1))

        seen = set(self.entries)
        queue = list(zip(far(self.entries).tolist(), self.entries, strict=True))
        best = [(-d, c) for d, c in queue]
        heapq.heapify(queue)
        heapq.heapify(best)
        while queue:
            d, c = heapq.heappop(queue)
            if len(best) >= width and d > -best[0][0]:
                break
            new = [int(n) for n in self.graph[c] if int(n) not in seen]
            if not new:
                continue
            seen.update(new)
            for e, n in zip(far(new).tolist(), new, strict=True):
                if len(best) < width or e < -best[0][0]:
                    heapq.heappush(queue, (e, n))
                    heapq.heappush(best, (-e, n))
                    if len(best) > width:
                        heapq.heappop(best)
        found = sorted((-d, c) for d, c in best)
        return np.array([c for _, c in found]), np.array([d for d, _ in found])

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and their lists: the nearest and, near a boundary, some more."""
        d = np.sqrt(distances(self.placed(x), self.centres))
        width = min(REPLICAS, d.shape[1])
        near = np.argpartition(d, width - 1, axis=1)[:, :width]
        own = np.take_along_axis(d, near, axis=1)
        rows, at = np.nonzero(own <= own.min(axis=1, keepdims=True) * CLOSURE)
        return rows, near[rows, at]


def _of_dim(rows: DataFrame, queries: DataFrame, dim: int, n: int, k: int) -> DataFrame:
    spark = rows.sparkSession
    rows, queries = rows.filter(F.size("v") == dim), queries.filter(F.size("v") == dim)
    index = spark.sparkContext.broadcast(Index(sample(rows, "v", dim, n, SAMPLE), min(CENTROIDS, max(1, n // LIST_MEAN))))
    kind = dict(rows.dtypes)["v"]

    def post(batches):
        for batch in batches:
            x = matrix(batch.column("v"), dim)
            for at in range(0, len(x), 2048):
                row, lists = index.value.lists(x[at : at + 2048])
                part = batch.take(pa.array(row + at))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int64)), *part.columns], names=["list", *part.schema.names])

    posted = keep(rows.select("vec_id", "v").mapInArrow(post, f"list long, vec_id long, v {kind}"), "nearest-lists")
    # At most twice CENTROIDS numbers.
    sizes = {r["list"]: r["n"] for r in posted.groupBy("list").agg(F.count("*").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(sizes)

    def choose(batches):
        for batch in batches:
            x = matrix(batch.column("v"), dim)
            take, lists, parts = [], [], []
            for i, q in enumerate(x):
                centres, far = index.value.walk(q)
                have = 0
                for c, d in zip(centres.tolist(), far.tolist(), strict=True):
                    # Too short a list of candidates goes on; otherwise the ratio decides.
                    if have >= 16 * k and d > RATIO * far[0]:
                        break
                    size = shared.value.get(c, 0)
                    have += size
                    for p in range(-(-size // LIST_ROWS)):
                        take.append(i)
                        lists.append(c)
                        parts.append(p)
            part = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), pa.array(parts, pa.int64()), *part.columns], names=["list", "part", *part.schema.names])

    def search(batches):
        for table in whole_groups(batches, "cell", 1):
            cells = table.column("cell").to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, cells[1:] != cells[:-1])), len(cells)).tolist()
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = table.slice(a, b - a)
                asks = part.column("asks").to_numpy(zero_copy_only=False).astype(bool)
                if not asks.any() or asks.all():
                    continue
                ids, v = part.column("vec_id").to_numpy(), matrix(part.column("v").combine_chunks(), dim)
                have, x = ids[~asks], v[~asks]
                # An id may have several vectors; only its nearest takes a place.
                several = len(np.unique(have)) < len(have)
                query_ids, q = ids[asks], v[asks]
                scores = (row for at in range(0, len(q), BLOCK) for row in exact(x, q[at : at + BLOCK]))
                for query, score in zip(query_ids, scores, strict=True):
                    order = np.lexsort((have, score))
                    order = order[~((have[order] == query) & (score[order] == 0))]
                    if several:
                        order = order[np.sort(np.unique(have[order], return_index=True)[1])]
                    order = order[:k]
                    out.append((np.full(len(order), query), have[order], score[order]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    ask = keep(queries.select("vec_id", "v").mapInArrow(choose, f"list long, part long, vec_id long, v {kind}"), "nearest-asks")
    # As many numbers at most. A list that no query asks is read no further.
    turns = {r["list"]: -(-r["n"] // LIST_ASKS) for r in ask.filter("part = 0").groupBy("list").agg(F.count("*").alias("n")).collect()}
    asked = spark.sparkContext.broadcast(turns)

    def divide(batches):
        """Rows go to the part of their list that their id names, once for each turn of its queries."""
        for batch in batches:
            lists, ids = batch.column("list").to_numpy(), batch.column("vec_id").to_numpy()
            parts = np.array([-(-shared.value[c] // LIST_ROWS) for c in lists.tolist()], dtype=np.int64)
            salt = (scatter(ids) >> np.uint64(1)).astype(np.int64) % np.maximum(parts, 1)
            times = np.array([asked.value.get(c, 0) for c in lists.tolist()], dtype=np.int64)
            take = np.repeat(np.arange(len(lists)), times)
            turn = np.arange(len(take)) - np.repeat(np.cumsum(times) - times, times)
            out = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([out.column("list"), pa.array(salt[take]), pa.array(turn), out.column("vec_id"), out.column("v")], names=["list", "part", "turn", "vec_id", "v"])

    def turn_of(batches):
        """Queries of a list go to its turns by their id."""
        for batch in batches:
            times = np.array([asked.value.get(c, 1) for c in batch.column("list").to_pylist()], dtype=np.int64)
            turn = (scatter(batch.column("vec_id").to_numpy()) >> np.uint64(1)).astype(np.int64) % np.maximum(times, 1)
            yield pa.RecordBatch.from_arrays([batch.column("list"), batch.column("part"), pa.array(turn), batch.column("vec_id"), batch.column("v")], names=["list", "part", "turn", "vec_id", "v"])

    schema = f"list long, part long, turn long, vec_id long, v {kind}"
    have = posted.mapInArrow(divide, schema).withColumn("asks", F.lit(False))
    dealt = have.unionByName(ask.mapInArrow(turn_of, schema).withColumn("asks", F.lit(True))).withColumn("cell", F.xxhash64("list", "part", "turn"))
    return grouped(dealt.select("cell", "vec_id", "v", "asks"), "cell").mapInArrow(search, "query_id long, vec_id long, score double")


def search(df: DataFrame, k: int = NEIGHBOURS, every: int = EVERY, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of each row whose id is divisible by ``every``."""
    rows = df.select(F.col(ident).cast("long").alias("vec_id"), F.col(vector).alias("v")).filter(usable("v") & F.col("vec_id").isNotNull())
    # Repeats would count as candidates and fill lists.
    rows = keep(rows.distinct(), "nearest-rows")
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    found = None
    for dim, n in dims(rows, "v"):
        part = _of_dim(rows, queries, dim, n, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = df.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
