"""Centroid clustering in JVM expressions: integer vectors, literal centroids, exact column sums.

Every component x becomes the integer floor(1024 * x). A distance is ``zip_with`` of the vector and a literal centroid,
folded by ``aggregate``; the nearest centroid is the ``array_min`` of structs (distance, number), so that ties go to the
smaller number. A round is one aggregate: sums of each component and a count by cluster, combined in each
task before they meet; only ``k`` rows of ``dim`` sums come to the driver, which floors them exactly. Integers make
the result the same whatever the order in which tasks add. No vector is moved but to the files of the integer table.

Cases: vectors that are null, have another number of components, or hold null or non-finite ones are left out; zero
vectors count. Components beyond 2 ** 17 in size count as 2 ** 17, so that a distance fits 64 bits; an inertia beyond 64
bits is the largest long. The first centroids are the vectors with the least sha256 of ``3:<vec_id>``; equal hashes (one id
repeated) go by the vectors' order, and a null id comes after all others. Fewer vectors than ``k`` make fewer centroids.
Repeated rows count as often as they occur; equal centroids leave all but the first of them empty, and an empty one stays where it is.
Extra columns do not matter, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.scratch import keep

CLUSTERS = 8
DIM = 64
ROUNDS = 10
SCALE = 1024
#: Largest size of a component after scaling: 64 squared differences of twice as much fit 62 bits.
MOST = 1 << 27
_LONG = (1 << 63) - 1


def integers(vectors: DataFrame, dim: int = DIM, vector: str = "embedding") -> DataFrame:
    """(vec_id, v): integer vectors of the rows that count."""
    good = (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    grid = F.transform(vector, lambda x: F.floor(F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), x.cast("double") * SCALE))).cast("int"))
    return vectors.filter(F.coalesce(good, F.lit(False))).select("vec_id", grid.alias("v"))


def first_centroids(grid: DataFrame, k: int, seed: str = "3") -> list[list[int]]:
    """The vectors whose ids hash least, in order of the hash."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r["v"] for r in grid.select(name.alias("name"), "v").orderBy(F.col("name").asc_nulls_last(), "v").limit(k).collect()]


def nearest(centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid to ``v``."""

    def distance(centroid: list[int]) -> Column:
        literal = F.expr(f"array({', '.join(f'{c}L' for c in centroid)})")
        squares = F.zip_with("v", literal, lambda x, c: (x - c) * (x - c))
        return F.aggregate(squares, F.lit(0).cast("long"), lambda total, x: total + x)

    return F.array_min(F.array(*[F.struct(distance(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]))


def moved(grid: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round: exact floors of the means of what is nearest to each."""
    dim = len(centroids[0])
    sums = [F.expr(f"sum(CAST(v[{i}] AS BIGINT)) AS s{i}") for i in range(dim)]
    found = grid.select(nearest(centroids)["cluster"].alias("cluster"), "v").groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect()
    out = list(centroids)
    for r in found:
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    return out


def fit(grid: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "3") -> list[list[int]]:
    """Centroids after ``rounds`` rounds."""
    centroids = first_centroids(grid, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(grid, centroids)
    return centroids


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, seed: str = "3") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that counts."""
    grid = keep(integers(vectors, dim), "centroid-grid")
    centroids = fit(grid, k, rounds, seed)
    if not centroids:
        return grid.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256").limit(0)
    put = keep(grid.select("vec_id", nearest(centroids).alias("to")).select("vec_id", "to.cluster", "to.distance"), "centroid-members")
    # A sum that does not fit a long is kept exact until it is cut to one.
    whole = {r["cluster"]: int(r["d"]) for r in put.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def of_cluster(values: list) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)

    each = [min(whole.get(i, 0), _LONG) for i in range(len(centroids))]
    return put.select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster(each).cast("long").alias("cluster_inertia"),
        F.lit(min(sum(whole.values()), _LONG)).cast("long").alias("inertia"),
        of_cluster(names).alias("centroid_sha256"),
    )
