"""Centroid clustering against a plain program in Python integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import centroids

NAN, INF = float("nan"), float("inf")


def plain(rows, k, dim, rounds=10):
    kept = [(i, [math.floor(1024 * min(131072, max(-131072, x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    means = [list(v) for _, v in first[:k]]
    of = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(means))
    for _ in range(rounds):
        near = [of(v)[1] for _, v in kept]
        for j in range(len(means)):
            own = [v for (_, v), n in zip(kept, near, strict=True) if n == j]
            if own:
                means[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    put = [(i, *of(v)) for i, v in kept]
    total = sum(d for _, d, _ in put)
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in means]
    cut = lambda n: min(n, 2**63 - 1)
    return sorted([(i, j, d, cut(sum(e for _, e, m in put if m == j)), cut(total), name[j]) for i, d, j in put], key=str)


def found(df, **kw):
    return sorted([tuple(r) for r in centroids.cluster(df, **kw).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()], key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters(embeddings_of, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 6))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 5] + rng.normal(size=6) * 0.3]) for i in range(150)]
    rows += [(900, None), (901, []), (902, [0.0] * 6), (903, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (904, [NAN] * 6), (905, [INF] * 6), (906, [1.0] * 5), (None, [0.5] * 6), (7, rows[7][1]), (7, rows[8][1])]
    assert found(embeddings_of(rows), dim=6) == plain(rows, 8, 6)


def test_ties_copies_and_few_rows(embeddings_of):
    copies = [(i, [0.25, -0.25]) for i in range(40)] + [(100, [-0.0009, 0.0009])]
    assert found(embeddings_of(copies), dim=2) == plain(copies, 8, 2)
    few = [(1, [1.0, 2.0]), (2, [3.0, -4.0])]
    assert found(embeddings_of(few), dim=2) == plain(few, 8, 2)


def test_components_of_any_size(embeddings_of):
    rows = [(i, [3e38 * (-1) ** i, 1e6, -1e-30, float(i)]) for i in range(30)]
    assert found(embeddings_of(rows), dim=4, k=3) == plain(rows, 3, 4)


def test_empty_and_clashing_names(embeddings_of):
    assert found(embeddings_of([])) == [] and found(embeddings_of([(1, None)])) == []
    rows = [(i, [float(i % 7), 1.0]) for i in range(20)]
    extra = embeddings_of(rows).select("*", *[F.lit(9).alias(c) for c in ("v", "cluster", "distance", "x", "c", "total", "name")])
    assert found(extra, dim=2, k=3) == plain(rows, 3, 2)
