"""Operators on vectors against brute force."""

import math

import numpy as np
import pytest

from tidemark.llm import graph, nearest, neardup

NAN, INF = float("nan"), float("inf")
ODD = [(5000, None), (5001, []), (5002, [0.0] * 8), (5003, [1.0, None] + [0.0] * 6), (5004, [NAN] * 8), (5005, [INF] * 8), (None, [1.0] * 8), (5006, [1.0, 1.0]), (5007, [2.0, 2.0])]


def vectors(seed, n=300, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    x = centres[rng.integers(20, size=n)] + rng.normal(size=(n, dim)) * rng.choice([0.0, 0.1, 0.5], size=(n, 1))
    return [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def classes(rows, threshold):
    n = len(rows)
    ok = [usable(v) for _, v in rows]
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    p, q = top(i), top(j)
                    up[max(p, q)] = min(p, q)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted([(d, links[i], least.get(top(i)) if ok[i] else d) for i, (d, _) in enumerate(rows)], key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(embeddings_of, seed):
    rows = vectors(seed) + ODD + [(7, vectors(seed)[7][1]), (6000, vectors(seed)[7][1])]
    out = neardup.classes(embeddings_of(rows)).collect()
    assert sorted([(r["vec_id"], r["n_links"], r["component_id"]) for r in out], key=str) == classes(rows, 0.9)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


@pytest.mark.parametrize("least, most", [(10, 1 << 20), (10, 8 * 8 * 12), (40, 8 * 8 * 3)])
def test_near_duplicates_over_many_tiles(embeddings_of, monkeypatch, least, most):
    """Several leaves, and leaves salted into several tiles; blocks smaller than tiles."""
    monkeypatch.setattr(neardup, "LEAST_TILE", least)
    monkeypatch.setattr(neardup, "TILE_BYTES", most)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rows = vectors(11, 500) + ODD + [(7, vectors(11)[7][1]), (6000, vectors(11)[7][1])]
    assert neardup.tiling(500, 8, 8) < 100
    out = neardup.classes(embeddings_of(rows)).collect()
    assert sorted([(r["vec_id"], r["n_links"], r["component_id"]) for r in out], key=str) == classes(rows, 0.9)


def test_near_duplicates_beside_clashing_columns(spark, embeddings_of):
    from pyspark.sql import functions as F

    rows = vectors(3, 60)
    clash = embeddings_of(rows).select("*", *[F.lit(i).alias(c) for i, c in enumerate(["node", "v", "ok", "h1", "h2", "copies", "list", "part", "leaf", "cell"])])
    assert sorted(tuple(r) for r in neardup.classes(clash).collect()) == sorted(tuple(r) for r in neardup.classes(embeddings_of(rows)).collect())
    assert sorted(tuple(r) for r in nearest.search(clash).collect()) == sorted(tuple(r) for r in nearest.search(embeddings_of(rows)).collect())


def test_tiles_grow_with_rows_until_they_are_full():
    assert neardup.tiling(100, 64, 6) == neardup.LEAST_TILE
    assert -(-51_282 // neardup.tiling(51_282, 64, 6)) == 7
    assert neardup.tiling(10**9, 64, 6) * 64 * 8 == neardup.TILE_BYTES


def test_near_duplicates_of_little(embeddings_of):
    assert neardup.classes(embeddings_of([])).collect() == []
    bad = neardup.classes(embeddings_of(ODD[:6])).collect()
    assert all((r["n_links"], r["component_id"], r["kept"]) == (0, r["vec_id"], True) for r in bad) and len(bad) == 6


@pytest.mark.parametrize("block, dense", [(2048, 0.02), (33, 0.02), (33, 1.1), (50, 0.0)])
@pytest.mark.parametrize("dim", [5, 40])
def test_tiles_stop_early_and_lose_nothing(monkeypatch, block, dense, dim):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "DENSE", dense)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, dim)) @ np.diag(np.linspace(3, 0.1, dim))
    x[100:120] = x[:20] + rng.normal(size=(20, dim)) * 0.05
    side = neardup.Side(x, neardup.Layout(x, 8))
    want = side.unit @ side.unit.T >= 0.9
    got = np.zeros((200, 200), bool)
    for i, j in neardup.hits(side, side, 0.9):
        got[i, j] = True
    assert (got == want).all()
    half = np.zeros((200, 200), bool)
    for i, j in neardup.hits(side, side, 0.9, same=True):
        half[i, j] = True
    assert (half == np.triu(want, 1)).all()


def test_labels_of_linked_pairs():
    label = neardup.merge(np.arange(7), np.array([0, 3]), np.array([3, 4]))
    assert label.tolist() == [0, 1, 2, 0, 0, 5, 6]
    assert neardup.merge(label, np.array([4, 6, 2]), np.array([5, 1, 6])).tolist() == [0, 1, 1, 0, 0, 0, 1]


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, size=(220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(50)] + [(7, 7)]
    up = {x: x for p in pairs for x in p}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        p, q = top(a), top(b)
        up[max(p, q)] = min(p, q)
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert set(found) == {x for a, b in pairs for x in (a, b) if a != b}
    groups = {}
    for x, r in found.items():
        groups.setdefault(r, set()).add(top(x))
        assert top(r) == top(x)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({top(x) for x in found})
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("seed, n", [(1, 1500), (2, 5), (3, 400)])
def test_nearest(embeddings_of, seed, n):
    rows = vectors(seed, n)
    rows += ODD + [(6000 + i, rows[0][1]) for i in range(30)]
    out = nearest.search(embeddings_of(rows)).collect()
    good = [(i, np.array(v)) for i, v in rows if usable(v) and i is not None and len(v) == 8]
    got = {}
    for r in out:
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hit = total = 0
    for q, v in good:
        if q % 100:
            continue
        near = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in good if i != q)[:10]
        mine = got[q]
        assert list(sorted(mine)) == list(range(1, len(near) + 1))
        assert [(s, i) for i, s in (mine[k] for k in sorted(mine))] == sorted((s, i) for i, s in mine.values())
        hit += len({i for i, _ in mine.values()} & {i for _, i in near})
        total += len(near)
    assert set(got) == {q for q, _ in good if q % 100 == 0}
    assert hit >= 0.9 * total


def test_nearest_reads_more_lists_of_more():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60_000, 64))
    index = nearest.Index(x[:6000], 1200)
    hit = 0
    for q in range(0, 60_000, 1500):
        near = np.argsort(((x - x[q]) ** 2).sum(axis=1))[1:11]
        centres, far = index.walk(x[q])
        read = centres[far <= nearest.RATIO * far[0]]
        row, lists = index.lists(x[near])
        hit += len(set(row[np.isin(lists, read)].tolist()))
    assert len(index.centres) > 1000 and hit >= 0.9 * 400


@pytest.mark.parametrize("times", [2, 12])
def test_nearest_of_repeated_rows(embeddings_of, times):
    rows = vectors(8, 400)
    of_one_id = [(7000, [float(x) for x in np.float32(rows[100][1]) + np.float32(i / 1000)]) for i in range(1, 31)]
    once = found_nearest(embeddings_of(rows + of_one_id))
    assert [len([x for x in once if x[0] == q]) for q in (0, 100, 200, 300)] == [10] * 4
    assert len([x for x in once if x[0] == 100 and x[2] == 7000]) == 1
    assert found_nearest(embeddings_of((rows + of_one_id) * times)) == once


def found_nearest(df):
    return sorted(tuple(r) for r in nearest.search(df).select("query_id", "rank", "vec_id", "score").collect() if r["query_id"] < 5000)


def test_nearest_of_little(embeddings_of):
    assert nearest.search(embeddings_of([])).collect() == []
    assert nearest.search(embeddings_of([(100, [1.0, 0.0])])).collect() == []
    one = nearest.search(embeddings_of([(100, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0, 1.0]), (5, None)])).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in one] == [(100, 1, 4, 1.0)]


def _doubles(spark, x):
    from pyspark.sql import functions as F

    names = [F.lit(i).alias(c) for i, c in enumerate(("list", "part", "asks", "turn", "v", "cell", "score", "rank", "query_id"))]
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>").select("*", *names)


def _near(x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    d[q] = np.inf
    return np.lexsort((np.arange(len(x)), d))[:k]


@pytest.mark.parametrize("shift, scale", [(0.0, 1.0), (1e8, 1.0), (-3e5, 1e-6), (0.0, 1e160), (0.0, 1e-170)])
def test_nearest_over_many_lists(spark, monkeypatch, shift, scale):
    """More than a hundred lists, each query reading a part of them; far origins and sizes change no neighbour."""
    for name, value in (("LIST_MEAN", 16), ("LIST_ROWS", 24), ("WALK", 24), ("LIST_ASKS", 2)):
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(60, 12)) * 3
    x = (centres[rng.integers(60, size=3000)] + rng.normal(size=(3000, 12)) + shift) * scale
    out = nearest.search(_doubles(spark, x)).collect()
    got = {}
    for r in out:
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(range(0, 3000, 100)) and all(len(g) == 10 for g in got.values())
    plain = x / scale if scale not in (1.0, 1e-6) else x
    hit = sum(len({i for i, _ in got[q].values()} & set(_near(plain, q).tolist())) for q in got)
    assert hit >= 0.9 * 10 * len(got)
    for q, g in got.items():
        for i, score in g.values():
            want = math.dist(x[q], x[i]) if scale < 1e100 else math.dist(plain[q], plain[i]) * scale
            assert score == pytest.approx(want, rel=1e-9)
