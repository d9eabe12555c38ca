"""The trie of conversations against nested dictionaries, over one and over many shards."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import trie

KIND = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_rebuilt(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(s)] for c, s in own.items()}
    out = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        out[c] = own.get(base, [])[:h] + s[h:]
    return out


def plain(rows):
    whole, nodes = plain_rebuilt(rows), {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    worth = {k: (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0) for k, m in nodes.items()}
    children, saved, leaves = dict.fromkeys(nodes, 0), dict(worth), dict.fromkeys(nodes, 0)
    for k in nodes:
        if k:
            children[k[:-1]] += 1
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] += not children[k]
        if k:
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    out = []
    for k, m in nodes.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(k))))
        out.append((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted([tuple(r) for r in df.select(*COLUMNS).collect()], key=str)


def made(seed, n=120, vocabulary=3, longest=9):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randrange(-60, 200), rng.randrange(10**12, 10**12 + 50)])
        for t in range(rng.choice([0, 1, 2, 3, longest])):
            rows.append((c, rng.choice([t, None, t, t]), rng.choice(["user", "bot", None]), rng.choice(["", None, "a b", "c  d\te", "x"][:vocabulary])))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nodes(spark, seed):
    rows = made(seed, vocabulary=2 + seed)
    assert found(trie.conversations(spark.createDataFrame(rows, KIND).repartition(3))) == plain(rows)


@pytest.mark.parametrize("seed, turns, slab", [(1, 4, 64), (2, 15, 2), (3, 60, 1), (4, 4, 3), (5, 200, 64)])
def test_many_shards(spark, monkeypatch, seed, turns, slab):
    """Paths that leave shards are combined over several levels; matrices narrower than rows."""
    monkeypatch.setattr(trie, "SLAB", slab)
    rows = made(seed, n=200, vocabulary=2, longest=12) + [(5000 + i, t, "user", "same") for i in range(30) for t in range(20 + i % 3)]
    ready = trie.keep(trie.sequences(trie.rebuilt(spark.createDataFrame(rows, KIND))), "sequences")
    assert found(trie.trie(ready, shard_turns=turns, least_turns=2)) == plain(rows)


def test_chunks_of_ids(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 4)
    rows = [(20 * i + 20, t, "user", "hello") for i in range(-40, 40) for t in range(2)]
    assert found(trie.conversations(spark.createDataFrame(rows, KIND))) == plain(rows)


def test_odd_rows(spark):
    long = "word " * 200_000
    rows = [(None, 0, "user", "x"), (1, 0, "u", long), (2, 0, "u", long), (1, 0, "u", long), (3, None, None, None), (0, 5, None, ""), (0, 5, "", None), (7, 1, "ab", "c"), (8, 1, "a", "bc")]
    extra = spark.createDataFrame(rows, KIND).select("*", *[F.lit(1).alias(c) for c in ("base", "names", "words", "n", "own", "head", "h", "place", "k1", "t")])
    assert found(trie.conversations(extra)) == plain(rows)
    assert found(trie.conversations(spark.createDataFrame([], KIND))) == []
    assert found(trie.conversations(spark.createDataFrame([(None, 1, "a", "b")], KIND))) == []


def test_order_and_shared_turns(monkeypatch):
    rng = np.random.default_rng(5)
    for slab in (1, 2, 64):
        monkeypatch.setattr(trie, "SLAB", slab)
        lengths = rng.integers(0, 9, 200)
        flat = rng.integers(1, 3, lengths.sum())
        starts = np.cumsum(lengths) - lengths
        rows = [tuple(flat[s : s + n].tolist()) for s, n in zip(starts, lengths, strict=True)]
        order, shared = trie.ordered(flat, starts, lengths)
        put = [rows[i] for i in order]
        assert put == sorted(rows)
        for i in range(1, len(put)):
            same = next((k for k, (a, b) in enumerate(zip(put[i - 1], put[i], strict=False)) if a != b), min(len(put[i - 1]), len(put[i])))
            assert shared[i] == same
