"""Similarity join of shingle sets with a count-vector R-tree.

A document's set: hashes of its distinct ``SHINGLE``-word runs, A-Z lower-cased. Two sets are linked when
100 * intersection >= ``PERCENT`` * union. The join is exact; nothing is sampled and no bucket is capped.

1. Equal texts are one text with a number of copies; from here on a node is a distinct text.
2. Linked sets share one of the first n - ceil(0.85 n) + 1 shingles of each, in any order that all
   sets use. The order puts shingles that are frequent in the corpus last (a list of bounded size), goes from
   shingles of rare words to those of common ones (another such list), and then by hash: so texts hardly name
   what texts share by chance. Such shingles that only one set has are dropped.
3. In the bucket of a rare shingle each set is a point: its shingles hashed to groups, the number in each
   group its coordinates. The overlap of two sets is at most the sum of coordinate minima. An R-tree packed
   over the points bounds that sum for whole nodes first. Of the pairs that survive, a spanning
   forest goes on. A frequent shingle joins all sets that have to name it: those hold little else.
4. Components of that candidate graph contain every linked pair. Each is verified by itself: R-tree again,
   then exact intersections. Large ones are dealt into tiles, every pair of tiles to a task, and only a
   spanning forest and the number of links of each text leave a task.
5. Components of the verified links give the classes.

Cases: null texts and texts without words have empty sets: they link with nothing, copies included. With
fewer words than a shingle the whole sequence is the one shingle. Repeated rows and equal texts link with
each other. component_id is the least non-null doc_id of the class (null if there is none). Extra columns
do not matter; an empty table gives an empty result. Very long texts are read whole; one must fit a task's memory some
forty times over.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import grouped, scatter, signed, small_batches, whole_groups, with_keys
from tidemark.llm.graph import components
from tidemark.llm.substrings import counted_runs, frequent_runs
from tidemark.llm.text import Words, grams, inside, mix, rounds
from tidemark.scratch import keep, keep_by

SHINGLE = 4
PERCENT = 85
FREQUENT = 2e-6
#: Share of all words from which on a word is common; levels go up by one with each doubling.
COMMON = 1e-5
#: Points of a leaf and children of a node of the R-tree.
FANOUT = 16
#: Least and most coordinates of a point.
GROUPS = (32, 4096)
#: Coordinates of the pairs that are compared at once.
BLOCK = 1 << 20
#: Buckets up to this many sets are compared all at once, larger ones through a tree.
SMALL = 6
#: Least and most texts of a tile, and into how many tiles a component is dealt between the two.
TILES = (128, 2048)
SPREAD = 32


@dataclasses.dataclass(frozen=True)
class Rule:
    """Words of a shingle and the similarity, in percent, from which sets are linked."""

    words: int = SHINGLE
    percent: int = PERCENT

    def needed(self, a, b):
        """Least intersection with which sets of these sizes are linked."""
        return -(-(self.percent * (a + b)) // (100 + self.percent))

    def prefix(self, n):
        """How many shingles of a set, first in order, one at least is shared with any linked set."""
        return n - -(-self.percent * n // 100) + 1


def by_number(values: np.ndarray, most: int) -> np.ndarray:
    """Stable order of small numbers under ``most``; short ones sort in linear time."""
    return np.argsort(values.astype(np.uint16 if most < 1 << 16 else np.int64), kind="stable")


def sets_of(texts, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and offsets."""
    runs, offsets, _ = levelled_sets(texts, n, None)
    return runs, offsets


def levelled_sets(texts, n: int, common: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``sets_of``, and the level of each shingle: the sum over its words, 0 for rare ones and for a text with fewer words."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    counts = np.diff(words.first)
    ok = inside(words.first, n)
    runs, doc = grams(hashes, n)[ok], words.doc()[: len(ok)][ok]
    level = np.zeros(len(runs), np.int64)
    if common is not None and len(common[0]) and len(runs):
        named, own = common[0], grams(hashes, 1)
        at = np.minimum(np.searchsorted(named, own), len(named) - 1)
        summed = np.append(0, np.cumsum(np.where(named[at] == own, common[1][at], 0)))
        level = (summed[n:] - summed[:-n])[ok]
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):
        short = []
        for i in few:
            h = np.uint64(counts[i])
            for x in hashes[words.first[i] : words.first[i + 1]]:
                h = mix(np.array([h], np.uint64) * np.uint64(0x9FB21C651E98DF25) + x)[0]
            short.append(h)
        runs, doc = np.append(runs, np.array(short, np.uint64)), np.append(doc, few)
        level = np.append(level, np.zeros(len(few), np.int64))
    order = np.argsort(runs)
    order = order[by_number(doc[order], len(words.first))]
    runs, doc, level = runs[order], doc[order], level[order]
    fresh = np.append(True, (runs[1:] != runs[:-1]) | (doc[1:] != doc[:-1])) if len(runs) else np.zeros(0, bool)
    runs, doc, level = runs[fresh], doc[fresh], level[fresh]
    return runs, np.searchsorted(doc, np.arange(len(words.first))), level


def common_words(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of common words and their levels, from 1 on."""
    words, counts, total = counted_runs(docs, 1, COMMON, lower=True)
    return words, 1 + np.log2(counts / (COMMON * total)).astype(np.int64)


def vectors(runs: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Count vector of each set: a power of two of groups, one for 4 to 8 shingles, within GROUPS.

    So unrelated sets hardly pass the bound: with 500 shingles they lie some five deviations below it. The first
    byte says how many bytes a count takes, 0 being half a byte.
    """
    out = []
    place = (runs >> np.uint64(20)).astype(np.int64)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        groups = min(GROUPS[1], max(GROUPS[0], 1 << int(max(b - a - 1, 0) // 8).bit_length()))
        counts = np.bincount(place[a:b] & (groups - 1), minlength=groups)
        most = counts.max()
        if most < 16:
            out.append(b"\0" + (counts[::2] + 16 * counts[1::2]).astype(np.uint8).tobytes())
        else:
            out.append(b"\1" + counts.astype(np.uint8).tobytes() if most < 256 else b"\4" + counts.astype(np.uint32).tobytes())
    return out


def halves(pairs: np.ndarray) -> np.ndarray:
    """Counts of half a byte each, along the last axis."""
    return np.stack([pairs & 15, pairs >> 4], axis=-1).reshape(*pairs.shape[:-1], -1)


def counts_of(packed: bytes) -> np.ndarray:
    if packed[0] == 0:
        return halves(np.frombuffer(packed, np.uint8, offset=1))
    return np.frombuffer(packed, np.uint8 if packed[0] == 1 else np.uint32, offset=1)


def fold(matrix: np.ndarray, groups: int) -> np.ndarray:
    """Counts of more groups summed to fewer; the bound still holds."""
    return matrix.reshape(len(matrix), -1, groups).sum(axis=1, dtype=np.int32) if matrix.shape[1] > groups else matrix


class RTree:
    """Points in order of size, packed bottom up; each node keeps the maxima of its coordinates and its least size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points[:, 0], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        high, low = self.points, self.sizes
        most = self.sizes
        self.levels = [(high, low, most)]
        while len(high) > 1:
            heads = np.arange(0, len(high), FANOUT)
            high = np.maximum.reduceat(high, heads, axis=0)
            low, most = np.minimum.reduceat(low, heads), np.maximum.reduceat(most, heads)
            self.levels.append((high, low, most))

    def pairs(self, rule: Rule):
        """Places i < j of all pairs whose bound reaches what a link needs, in blocks."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, left, right = stack.pop()
            step = max(1, min(1 << 13, BLOCK // self.points.shape[1]))
            for at in range(0, len(left), step):
                a, b = left[at : at + step], right[at : at + step]
                high, low, most = self.levels[level]
                # The smaller size of a pair lies in the left node, as places are in order of size.
                ok = 100 * most[a] >= rule.percent * low[b]
                a, b = a[ok], b[ok]
                bound = np.minimum(high[a], high[b]).sum(axis=1, dtype=np.int64)
                ok = bound >= rule.needed(low[a], low[b])
                a, b = a[ok], b[ok]
                if not len(a):
                    continue
                if level == 0:
                    keep_ = a < b
                    yield a[keep_], b[keep_]
                    continue
                below = len(self.levels[level - 1][1])
                child = np.arange(FANOUT)
                x = (a[:, None] * FANOUT + child)[:, :, None]
                y = (b[:, None] * FANOUT + child)[:, None, :]
                x, y = np.broadcast_arrays(x, y)
                ok = (x <= y) & (x < below) & (y < below)
                stack.append((level - 1, x[ok], y[ok]))


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _matrix(packed: list[bytes]) -> np.ndarray:
    """Count vectors as one array with the groups of the coarsest."""
    lists = [counts_of(x) for x in packed]
    groups = min(len(x) for x in lists)
    return np.stack([fold(x[None, :].astype(np.int32), groups)[0] for x in lists]).astype(np.int32)


def surviving(packed: list[bytes], n: np.ndarray, rule: Rule):
    """Pairs of places whose bound reaches what a link needs.

    Sets are taken by the number of their groups, each with the next larger ones of like size, so that
    a small set does not make the points of large ones coarse.
    """
    groups = np.array([len(counts_of(x)) for x in packed])
    for kind in np.unique(groups):
        own = groups == kind
        most = n[own].max()
        near = (groups > kind) & (rule.percent * n <= 100 * most)
        at = np.flatnonzero(own | near)
        if len(at) < 2:
            continue
        tree = RTree(_matrix([packed[i] for i in at.tolist()]), n[at])
        order = at[tree.order]
        for left, right in tree.pairs(rule):
            a, b = order[left], order[right]
            ok = own[a] | own[b]
            yield from zip(a[ok].tolist(), b[ok].tolist(), strict=True)


def _rare(frequent: np.ndarray, runs: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.ones(len(runs), bool)
    return frequent[np.minimum(np.searchsorted(frequent, runs), len(frequent) - 1)] != runs


def _candidates(docs: DataFrame, frequent, common, rule: Rule) -> DataFrame:
    """(k1, k2, tokens): of the shingles that a set has to name, those that another set names too."""
    schema = "route long, n int, k1 long, k2 long, token long"

    def work(batches):
        for batch in batches:
            for part, texts in rounds(batch, "text"):
                runs, offsets, level = levelled_sets(texts, rule.words, common.value)
                sizes = np.diff(offsets)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                k1, k2 = part.column("k1").to_numpy(), part.column("k2").to_numpy()
                # Copies of a text in this round name nothing.
                first = np.zeros(len(sizes), bool)
                by_key = np.lexsort((k2, k1))
                first[by_key] = np.append(True, (k1[by_key][1:] != k1[by_key][:-1]) | (k2[by_key][1:] != k2[by_key][:-1]))
                order = by_number(level, int(level.max(initial=0)) + 1)
                order = order[by_number((2 * doc + ~_rare(frequent.value, runs))[order], 2 * len(sizes))]
                place = np.arange(len(runs)) - offsets[doc]
                use = order[(place < rule.prefix(sizes)[doc]) & first[doc]]
                token, doc = runs[use], doc[use]
                _, inverse, counts = np.unique(token, return_inverse=True, return_counts=True)
                many = counts[inverse] > 1
                known = np.unique(token[many])
                empty = np.zeros(len(known), np.int64)
                mask = np.append(np.zeros(len(token), bool), np.ones(len(known), bool))
                # A row is its shingle's own, which the route names, unless it is known to be shared.
                route = np.where(many, scatter(k1[doc], signed(token)), token)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(np.append(route, known))),
                        pa.array(np.append(np.where(many, 0, 1), empty + 2).astype(np.int32)),
                        pa.array(np.append(k1[doc], empty), mask=mask),
                        pa.array(np.append(k2[doc], empty), mask=mask),
                        pa.array(np.append(signed(token), empty), mask=np.append(~many, np.ones(len(known), bool))),
                    ],
                    names=["route", "n", "k1", "k2", "token"],
                )

    rows = docs.select("k1", "k2", "text").mapInArrow(work, schema)
    w = Window.partitionBy("route")
    ends = [f(k).over(w).alias(f"{n}{k}") for k in ("k1", "k2") for n, f in (("lo_", F.min), ("hi_", F.max))]
    both = rows.select("*", F.max("n").over(w).alias("most"), *ends)
    # Two rows of one text from two tasks name nothing that another set has.
    other = (F.col("lo_k1") != F.col("hi_k1")) | (F.col("lo_k2") != F.col("hi_k2"))
    found = both.filter(F.col("k1").isNotNull() & ((F.col("n") == 0) | (F.col("most") > 1) | other))
    return found.groupBy("k1", "k2").agg(F.collect_set(F.coalesce("token", "route")).alias("tokens"))


def _small(cuts: np.ndarray, n: np.ndarray, packed: list[bytes], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Rows of surviving pairs in buckets of at most SMALL rows, all at once; ``cuts``: heads and end of buckets."""
    size = np.diff(cuts)
    left, right = [], []
    for k in range(2, SMALL + 1):
        heads = cuts[:-1][size == k]
        i, j = np.triu_indices(k, 1)
        left.append((heads[:, None] + i).ravel())
        right.append((heads[:, None] + j).ravel())
    a, b = np.concatenate(left), np.concatenate(right)
    ok = 100 * np.minimum(n[a], n[b]) >= rule.percent * np.maximum(n[a], n[b])
    a, b = a[ok], b[ok]
    length = np.array([(len(x) - 1) * (2 - x[0]) if x[0] < 2 else 0 for x in packed])
    halved = np.array([x[0] == 0 for x in packed])
    keep_ = np.zeros(len(a), bool)
    # Pairs whose vectors have the same two lengths are compared together, at the smaller one.
    kinds = np.minimum(length[a], length[b]) * (1 << 20) + np.maximum(length[a], length[b])
    for kind in np.unique(kinds):
        at = np.flatnonzero(kinds == kind)
        step = max(1, min(4096, BLOCK // max(1, int(kind) & ((1 << 20) - 1))))
        for start in range(0, len(at), step):
            own = at[start : start + step]
            if kind < 1 << 20:  # counts over a byte: one by one
                for x in own.tolist():
                    m = _matrix([packed[a[x]], packed[b[x]]])
                    keep_[x] = np.minimum(m[0], m[1]).sum() >= rule.needed(int(n[a[x]]), int(n[b[x]]))
                continue
            groups = int(kind >> 20)
            sides = []
            for rows in (a[own], b[own]):
                out = np.empty((len(rows), groups), np.int32)
                for width in np.unique(length[rows]):
                    for half in (False, True):
                        some = np.flatnonzero((length[rows] == width) & (halved[rows] == half))
                        if len(some):
                            joined = np.frombuffer(b"".join(packed[r] for r in rows[some].tolist()), np.uint8).reshape(len(some), -1)[:, 1:]
                            out[some] = fold(halves(joined) if half else joined, groups)
                sides.append(out)
            keep_[own] = np.minimum(*sides).sum(axis=1) >= rule.needed(n[a[own]], n[b[own]])
    return a[keep_], b[keep_]


def _candidate_edges(able: DataFrame, frequent, rule: Rule) -> DataFrame:
    """(a, b): a graph in whose components all linked pairs lie."""

    def send(batches):
        for batch in batches:
            for part, texts in rounds(batch, "text"):
                runs, offsets = sets_of(texts, rule.words)
                packed = vectors(runs, offsets)
                tokens = part.column("tokens")
                doc = np.repeat(np.arange(part.num_rows), tokens.value_lengths().to_numpy())
                token = tokens.flatten().to_numpy()
                rare = _rare(frequent.value, token.view(np.uint64))
                doc, token = doc[rare], token[rare]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(token),
                        pa.array(part.column("k1").to_numpy()[doc]),
                        pa.array(np.diff(offsets)[doc].astype(np.int32)),
                        pa.array([packed[i] for i in doc.tolist()], pa.binary()),
                    ],
                    names=["token", "k1", "n", "counts"],
                )

    def hubs(batches):
        for batch in batches:
            tokens = batch.column("tokens")
            doc = np.repeat(np.arange(batch.num_rows), tokens.value_lengths().to_numpy())
            token = tokens.flatten().to_numpy().view(np.uint64)
            hot = ~_rare(frequent.value, token)
            # A frequent shingle is a node of its own, named apart from texts.
            node = signed(mix(token[hot] ^ np.uint64(0x73686E676C65)))
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("k1").to_numpy()[doc[hot]]), pa.array(node)], names=["a", "b"])

    def search(batches):
        for table in whole_groups(batches, "token"):
            token = table.column("token").to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token))
            k1, n = table.column("k1").to_numpy(), table.column("n").to_numpy().astype(np.int64)
            packed = table.column("counts").to_pylist()
            i, j = _small(cuts, n, packed, rule)
            a, b = [k1[i]], [k1[j]]
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if y - x > SMALL:
                    forest, own = Forest(y - x), k1[x:y]
                    pairs = np.array([p for p in surviving(packed[x:y], n[x:y], rule) if forest.join(*p)], dtype=np.int64).reshape(-1, 2)
                    a.append(own[pairs[:, 0]])
                    b.append(own[pairs[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    sent = able.select(F.col("node").alias("k1"), "text", "tokens").mapInArrow(send, "token long, k1 long, n int, counts binary")
    near = grouped(sent, "token").mapInArrow(search, "a long, b long")
    return near.unionByName(able.select(F.col("node").alias("k1"), "tokens").mapInArrow(hubs, "a long, b long"))


def _links(texts: pa.Table, same: np.ndarray, rule: Rule):
    """Linked pairs among texts (places in the table); ``same`` allows a pair (i, j) by their sides."""
    # The work arrays of a text are some forty times as large as it is; those of a cell's texts need not live together.
    found = [sets_of(part, rule.words) for batch in texts.select(["text"]).to_batches() for _, part in rounds(batch, "text")]
    runs = np.concatenate([r for r, _ in found])
    n = np.concatenate([np.diff(o) for _, o in found])
    offsets = np.append(0, np.cumsum(n))
    for i, j in surviving(vectors(runs, offsets), n, rule):
        if same[i] == same[j] == 0 or same[i] != same[j]:
            a, b = runs[offsets[i] : offsets[i + 1]], runs[offsets[j] : offsets[j + 1]]
            if len(a) and len(b):
                both = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)
                if 100 * both >= rule.percent * (len(a) + len(b) - both):
                    yield i, j


def _verified(able: DataFrame, cells: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, n): forest edges of the links and, with b null, the number of documents linked to text a."""
    size = cells.groupBy("root").agg(F.count("*").alias("size"))
    # A text goes to as many cells as its component has tiles: some tens at most, until tiles are full.
    tile = F.least(F.greatest(F.ceil(F.col("size") / SPREAD), F.lit(TILES[0])), F.lit(TILES[1]))
    placed = cells.join(size, "root").select("root", "node", F.ceil(F.col("size") / tile).cast("int").alias("tiles"))
    # Texts are moved once, to their tiles; finding their cells moves names only.
    placed = able.select("k1", "k2", "node").join(placed, "node").drop("node")
    dealt = able.join(keep(placed, "jaccard-cells"), ["k1", "k2"]).withColumn("tile", F.pmod(F.xxhash64("k1"), F.col("tiles")).cast("int"))
    # A text goes to the pairs of its tile with every tile; side 0: both tiles are the same one.
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = dealt.select("root", F.col("node").alias("k1"), "copies", "text", "tile", other.alias("other"))
    dealt = dealt.select(
        F.xxhash64("root", F.least("tile", "other"), F.greatest("tile", "other")).alias("cell"),
        F.when(F.col("tile") == F.col("other"), 0).when(F.col("tile") < F.col("other"), 1).otherwise(2).alias("side"),
        "k1",
        "copies",
        "text",
    )

    def work(batches):
        for table in whole_groups(batches, "cell", 2_000):
            cell = table.column("cell").to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell)).tolist()
            a, b, n = [], [], []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y - x < 2:
                    continue
                part = table.slice(x, y - x)
                k1, copies, side = (part.column(c).to_numpy() for c in ("k1", "copies", "side"))
                forest, links = Forest(y - x), np.zeros(y - x, np.int64)
                for i, j in _links(part, side, rule):
                    links[i] += copies[j]
                    links[j] += copies[i]
                    if forest.join(i, j):
                        a.append(k1[i])
                        b.append(k1[j])
                        n.append(0)
                some = np.flatnonzero(links)
                a.extend(k1[some].tolist())
                b.extend([None] * len(some))
                n.extend(links[some].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    return grouped(dealt, "cell").mapInArrow(work, "a long, b long, n long")


def counted(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, k1, k2, n_shingles) of each row."""

    def work(batches):
        for batch in batches:
            for part, texts in rounds(batch, "text"):
                _, offsets = sets_of(texts, rule.words)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("k1"), part.column("k2"), pa.array(np.diff(offsets).astype(np.int64))],
                    names=["doc_id", "k1", "k2", "n_shingles"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "k1", "k2", "text").mapInArrow(work, f"doc_id {kind}, k1 long, k2 long, n_shingles long")


def classes(keyed: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc_id, k1, k2, text): (doc_id, k1, k2, n_shingles), and (k1, k2, c1, c2, component_id, n_links).

    c1 and c2 name the class: its root, and where a text is linked with no other the text itself.
    """
    frequent = keyed.sparkSession.sparkContext.broadcast(frequent_runs(keyed, rule.words, FREQUENT, lower=True))
    common = keyed.sparkSession.sparkContext.broadcast(common_words(keyed))
    with small_batches(keyed.sparkSession):
        return _classes(keyed, frequent, common, rule)


def _classes(keyed: DataFrame, frequent, common, rule: Rule) -> tuple[DataFrame, DataFrame]:
    found = _candidates(keyed, frequent, common, rule)
    texts = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    # A number hashed alone keeps a value of its own: no two texts share a node, even if they share k1.
    able = keep_by(texts.join(found, ["k1", "k2"]).withColumn("number", F.monotonically_increasing_id()), "jaccard-texts", "k1", "k2")
    able = able.withColumn("node", F.xxhash64("number")).drop("number")
    cells = components(_candidate_edges(able, frequent, rule))
    links = keep(_verified(able, cells, rule), "jaccard-links")
    linked = components(links.filter("b is not null").select("a", "b")).withColumnRenamed("node", "at")
    degree = links.filter("b is null").groupBy("a").agg(F.sum("n").alias("more"))
    joined = degree.join(linked, degree["a"] == linked["at"], "left").select("a", "more", "root")
    named = able.select("k1", "k2", "node").join(joined, F.col("node") == F.col("a")).select("k1", "k2", "more", "root")
    rows = keep(counted(keyed, rule), "jaccard-rows")
    own = rows.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    own = own.join(named, ["k1", "k2"], "left").withColumns({"c1": F.coalesce("root", "k1"), "c2": F.when(F.col("root").isNull(), F.col("k2"))})
    least = own.filter("root is not null").groupBy("root").agg(F.min("least").alias("of_root"))
    own = own.join(least, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("of_root"))
    links_of = F.col("copies") - 1 + F.coalesce("more", F.lit(0))
    return rows, keep(own.select("k1", "k2", "c1", "c2", component.alias("component_id"), links_of.alias("n_links")), "jaccard-classes")


_LAST = (1 << 63) - 1


def keyed_texts(docs: DataFrame) -> DataFrame:
    return with_keys(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def join(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of each row of ``docs`` (doc_id, text)."""
    rows, own = classes(keyed_texts(docs), rule)
    return rows.join(own, ["k1", "k2"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def representatives(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs`` without those that a kept row of their class stands for.

    Of each class one row with the least doc_id stays (of equals, one). Rows with an empty set all stay.
    """
    whole = F.coalesce(F.col("text"), F.lit(""))
    rows, own = classes(keyed_texts(docs), rule)
    placed = rows.filter("n_shingles > 0").join(own, ["k1", "k2"])
    # A null id comes last: it stays only where no row of the class has another.
    order = F.struct(_rank("doc_id").alias("i"), F.col("k1"), F.col("k2"))
    first = keep(placed.groupBy("c1", "c2").agg(F.min(order).alias("x")).select("x.*"), "jaccard-first")
    # The id is part of the key, so copies of one text do not meet in one task. The caller's columns travel as one.
    texts = docs.select(F.struct("*").alias("row"), _rank("doc_id").alias("i"), F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit(0x7465), whole).alias("k2"))
    chosen = texts.join(first, ["i", "k1", "k2"], "left_semi").dropDuplicates(["i", "k1", "k2"])
    bare = docs.filter(~F.regexp_like(whole, F.lit(r"[^\x20\x09-\x0D]")))
    return chosen.select("row.*").unionByName(bare)


def _rank(ident: str):
    return F.coalesce(F.col(ident).cast("long"), F.lit(_LAST))
