"""Prefix trie of conversations: what many of them share at their start, counted at every depth.

Conversations become sequences of turn names (128 bits of role and text), rebuilt with the head of another one
(``rebuilt``); conversations with the same sequence become one row with their number, their least conv_id and the hash of their ids. The
rows are dealt into shards that are ranges of the sequences' order. In a shard they form a padded matrix of turn numbers, which
``numpy.lexsort`` orders. A row differs from the one before in its first d turns where the OR-accumulated changes of its columns say so:
there a node of depth d starts, and ``reduceat`` over these starts aggregates each depth, from the deepest up.

Only nodes on the paths of a shard's first and last row can go on in another shard. These two paths leave the shard as rows
with what it has of each node, and are combined by the same step over fewer shards, until one is left. Then the
conv_ids of these nodes go back down, as parents of the shards' own nodes. A matrix has at most ``SLAB`` columns at once, so a few long
conversations do not widen it for all.

Cases: null role or text is an empty one; a null turn comes first, and turns with one number go by role, then text; rows
with a null conv_id are no conversation. Repeated rows are repeated turns. Conversations without own turns or whose base is
absent keep what is left, down to no turn. Very long texts are hashed whole and moved once; of each turn 20 bytes are kept with
its conversation, which must fit a task. Extra columns do not matter, whatever their names. An empty table gives no nodes, not even a root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scratch import keep

#: Conversations that share the head of one, and how many lengths a head may have.
BLOCK, HEADS = 20, 4
#: Turns of a shard, about; and the fewest for which another is worth a task.
SHARD_TURNS, LEAST_TURNS = 1 << 19, 1 << 14
SLAB = 64
#: Ids that are joined to one text before they meet to be hashed (a power of two).
CHUNK = 256
_NONE = np.iinfo(np.int64).max
EMPTY = hashlib.sha256(b"").hexdigest()

_PATH = "names array<bigint>, words array<int>, n array<bigint>, conv array<bigint>, children array<bigint>, leaves array<bigint>, saved array<bigint>, ends array<string>"
_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
#: kind 0: a node; 1: a path that leaves the shard; 2: conv_ids along a path that came in as a row.
_OUT = f"kind int, shard int, side int, {_NODE}, {_PATH}, from_shard int, from_side int, convs array<bigint>"


def rebuilt(turns: DataFrame, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """(conv_id, names, words): the first h turns of conversation c - c % block, then c's own after its first h."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("int")
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    base = F.col("conv_id") - F.col("conv_id") % block
    rows = turns.filter(F.col("conv_id").isNotNull()).select(base.alias("base"), "conv_id", "turn", role, text, words.alias("words"))
    # All that follows keeps this partitioning: a head and those that take it lie in one task.
    rows = rows.repartition("base")
    order = Window.partitionBy("base", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    name = [F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(0x7475), "role", "text").alias("k2")]
    placed = rows.withColumn("place", F.row_number().over(order)).select("base", "conv_id", "place", *name, "words")
    own = placed.groupBy("base", "conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "k1", "k2", "words"))).alias("own"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    head = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, heads - 1)), ignorenulls=True).over(Window.partitionBy("base"))
    both = own.withColumns({"head": head, "h": h})
    taken = F.when(F.col("h") > 0, F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array())).otherwise(F.array())
    rest = F.filter("own", lambda x: x["place"] > F.col("h"))
    whole = both.select("conv_id", F.concat(taken, rest).alias("t"))
    names = F.flatten(F.transform("t", lambda x: F.array(x["k1"], x["k2"])))
    return whole.select("conv_id", names.alias("names"), F.col("t.words").alias("words"))


def sequences(convs: DataFrame) -> DataFrame:
    """(names, words, n, conv, ends): each distinct sequence with its conversations' number, least id and hash of ids."""
    key = [F.xxhash64("names").alias("k1"), F.xxhash64(F.lit(0x7376), "names").alias("k2")]
    kept = keep(convs.select(*key, "conv_id", "names", "words"), "conversations")
    chunk = F.floor(F.col("conv_id") / F.lit(CHUNK)) if CHUNK & (CHUNK - 1) else F.shiftright("conv_id", CHUNK.bit_length() - 1)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    packed = kept.groupBy("k1", "k2", chunk.alias("chunk")).agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"), listed.alias("ids"))

    def hashed(batches):
        """Ids of one sequence follow each other; the state of one hash is all that is held."""
        key, state, n, conv, out = None, None, 0, 0, []
        for batch in batches:
            for k1, k2, m, c, ids in zip(*(batch.column(x).to_pylist() for x in ("k1", "k2", "n", "conv", "ids")), strict=True):
                if (k1, k2) != key:
                    if key is not None:
                        out.append((*key, n, conv, state.hexdigest()))
                    key, state, n, conv = (k1, k2), hashlib.sha256(ids.encode()), m, c
                else:
                    state.update(b"," + ids.encode())
                    n += m
            if len(out) >= 10_000:
                yield _table(out, _ENDS)
                out = []
        if key is not None:
            out.append((*key, n, conv, state.hexdigest()))
        yield _table(out, _ENDS)

    ends = packed.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "chunk").mapInArrow(hashed, "k1 long, k2 long, n long, conv long, ends string")
    once = kept.groupBy("k1", "k2").agg(F.first("names").alias("names"), F.first("words").alias("words"))
    return once.join(ends, ["k1", "k2"]).select("names", "words", "n", "conv", "ends")


_ENDS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("conv", pa.int64()), ("ends", pa.string())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def turn_numbers(names: np.ndarray) -> np.ndarray:
    """Numbers from 1 of names (pairs of 64 bits), in the order of the names."""
    pairs = names.reshape(-1, 2)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    put = pairs[order]
    new = np.ones(len(put), np.int64)
    new[1:] = (put[1:] != put[:-1]).any(axis=1)
    out = np.empty(len(put), np.int64)
    out[order] = np.cumsum(new)
    return out


def padded(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray, low: int, width: int) -> np.ndarray:
    """Columns ``low`` to ``low + width`` of these rows; 0, which comes before every turn, where a row has ended."""
    place = low + np.arange(width)
    there = place < lengths[rows][:, None]
    at = np.where(there, starts[rows][:, None] + place, 0)
    return np.where(there, flat[at] if len(flat) else 0, 0)


def ordered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the sequences, and in that order how many first turns each has in common with the one before."""
    n = len(lengths)
    order, shared = np.arange(n), np.zeros(n, np.int64)
    group = np.zeros(n, np.int64)
    active, low = np.arange(n), 0
    while len(active):
        # Places of rows that agree so far; they are sorted by the next columns within their group.
        width = max(1, min(SLAB, int(lengths[order[active]].max()) - low))
        part = padded(flat, starts, lengths, order[active], low, width)
        again = np.lexsort((*part.T[::-1], group[active]))
        order[active] = order[active][again]
        part = part[again]
        change = np.zeros(part.shape, bool)
        change[1:] = part[1:] != part[:-1]
        other = np.ones(len(active), bool)
        other[1:] = group[active][1:] != group[active][:-1]
        change[other, 0] = True
        mask = np.logical_or.accumulate(change, axis=1)
        shared[active] += np.where(other, 0, (~mask).sum(axis=1))
        new = mask[:, -1]
        group[active] = np.cumsum(new) + (group.max() + 1 if n else 0)
        # Those that have not ended and still agree with a neighbour go on.
        same = ~new
        tied = same.copy()
        tied[:-1] |= same[1:]
        active = active[tied & (lengths[order[active]] >= low + width)]
        low += width
    return order, np.minimum(shared, lengths[order])


class Rows:
    """Rows of a shard: sequences, and what is known of the node at each depth of each (depth 0 included)."""

    def __init__(self, table: pa.Table):
        column = {c: table.column(c).combine_chunks() for c in table.column_names}
        flat = lambda c: column[c].flatten().to_numpy(zero_copy_only=False)
        self.names = flat("names").astype(np.int64)
        self.lengths = np.diff(column["words"].offsets.to_numpy()).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.at = np.cumsum(self.lengths + 1) - (self.lengths + 1)
        self.words = flat("words").astype(np.int64)
        every = self.lengths + 1
        last = self.at + self.lengths
        if pa.types.is_list(column["n"].type):
            self.values = {c: flat(c).astype(np.int64) for c in ("n", "conv", "children", "leaves", "saved")}
            self.ends = np.array(flat("ends"), dtype=object)
            self.origin = (column["from_shard"].to_numpy(), column["from_side"].to_numpy())
        else:
            zero = np.zeros(int(every.sum()), np.int64)
            self.values = {"n": np.repeat(column["n"].to_numpy(), every), "conv": np.repeat(column["conv"].to_numpy(), every), "children": zero, "leaves": zero, "saved": zero}
            self.ends = np.full(len(zero), None, dtype=object)
            self.ends[last] = column["ends"].to_pylist()
            self.origin = None


def nodes(rows: Rows, shard: int, closed: bool) -> list[pa.RecordBatch]:
    """Nodes of a shard, and the paths that leave it (none if it is ``closed``, being the only one)."""
    order, shared = ordered(turn_numbers(rows.names), rows.starts, rows.lengths)
    length, at = rows.lengths[order], rows.at[order]
    n, deepest = len(order), int(rows.lengths.max())
    out: list[tuple] = []
    paths: dict[int, list] = {0: [None] * (length[0] + 1), 1: [None] * (length[-1] + 1)}
    conv_of = np.zeros(int((rows.lengths + 1).sum()), np.int64) if rows.origin is not None else None
    #: Of nodes one deeper, by their first row: 1, leaves and saved tokens of a node that is whole, and its place in ``out``.
    child = np.zeros(n, np.int64)
    leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64)
    waiting: tuple = ()
    for depth in range(deepest, -1, -1):
        live = np.flatnonzero(length >= depth)
        first = np.flatnonzero(shared[live] < depth) if depth else np.zeros(1, np.int64)
        if depth and (not len(first) or first[0] != 0):
            first = np.append(0, first)
        here = at[live] + depth
        total = lambda x: np.add.reduceat(x, first)  # noqa: B023,E731
        top = live[first]
        count, conv = total(rows.values["n"][here]), np.minimum.reduceat(rows.values["conv"][here], first)
        children = total(rows.values["children"][here]) + total(child[live])
        below = total(rows.values["leaves"][here]) + total(leaves[live])
        worth = total(rows.values["saved"][here]) + total(saved[live])
        words = rows.words[rows.starts[order[top]] + depth - 1] if depth else np.zeros(1, np.int64)
        # The hash of those that end here stands with one row of the node at most.
        ends = np.full(len(first), None, dtype=object)
        told = np.flatnonzero(rows.ends[here] != None)  # noqa: E711
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(live))))
        ends[of[told]] = rows.ends[here][told]
        edge = np.zeros(len(first), bool)
        sides: dict[int, int] = {}
        if not closed:
            if length[0] >= depth:
                sides[0] = 0
            if length[-1] >= depth:
                sides.setdefault(len(first) - 1, 1)
            edge[list(sides)] = True
        if waiting:
            # Parents of the nodes one deeper, whose rows lie within one of these.
            parent = np.searchsorted(top, waiting[0], side="right") - 1
            cut = edge[parent]
            side = np.array([sides.get(int(p), 0) for p in parent]) if cut.any() else np.zeros(len(parent), np.int64)
            known = pa.array(np.where(cut, 0, conv[parent]), mask=cut)
            out.append((*waiting[1:3], known, *waiting[3:], np.where(cut, side, -1)))
        for place, side in sides.items():
            paths[side][depth] = (count[place], conv[place], children[place], below[place], worth[place], ends[place])
        whole = ~edge
        below = np.where(whole & (children == 0), 1, below)
        worth = worth + np.where(whole, (count - 1) * words, 0)
        child[:], leaves[:], saved[:] = 0, 0, 0
        child[top[whole]], leaves[top[whole]], saved[top[whole]] = 1, below[whole], worth[whole]
        waiting = (top[whole], conv[whole], np.full(whole.sum(), depth), count[whole], children[whole], below[whole], worth[whole], ends[whole])
        if conv_of is not None:
            conv_of[here] = np.where(edge, _NONE - np.array([sides.get(i, 0) for i in range(len(first))]), conv)[of]
    if len(waiting[0]):
        out.append((*waiting[1:3], pa.nulls(len(waiting[0]), pa.int64()), *waiting[3:], np.full(len(waiting[0]), -1)))
    batches = [_nodes_batch(shard, *x) for x in out if len(x[0])]
    if not closed:
        batches.append(_paths_batch(rows, shard, order, paths, n))
    if conv_of is not None:
        batches.append(_convs_batch(rows, shard, conv_of))
    return batches


def _schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    fields = []
    for part in _OUT.split(", "):
        name, kind = part.split(" ")
        fields.append((name, pa.list_(kinds[kind[6:-1]]) if kind.startswith("array") else kinds[kind]))
    return pa.schema(fields)


def _batch(size: int, **columns) -> pa.RecordBatch:
    schema = _schema()
    given = {k: v if isinstance(v, pa.Array) else pa.array(v, schema.field(k).type) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(size, f.type) for f in schema], schema=schema)


def _nodes_batch(shard, conv, depth, parent, count, children, leaves, saved, ends, side) -> pa.RecordBatch:
    ends = pa.array([e or EMPTY for e in ends], pa.string())
    return _batch(
        len(conv), kind=np.zeros(len(conv), np.int32), shard=np.full(len(conv), shard, np.int32), side=side.astype(np.int32), conv_id=conv, depth=depth.astype(np.int64),
        parent_conv_id=parent, n_convs=count, n_children=children, n_leaves=leaves, saved_tokens=saved, ends_sha256=ends,
    )


def _paths_batch(rows: Rows, shard: int, order: np.ndarray, paths: dict[int, list], n: int) -> pa.RecordBatch:
    """The first row's path, and the last row's where it is another; what both hold stands with the first."""
    nothing = (0, _NONE, 0, 0, 0, None)
    sides = [0, 1] if n > 1 else [0]
    columns: dict[str, list] = {c: [] for c in ("names", "words", "n", "conv", "children", "leaves", "saved", "ends")}
    for side in sides:
        row = order[0 if side == 0 else -1]
        start, length = rows.starts[row], rows.lengths[row]
        columns["names"].append(rows.names[2 * start : 2 * (start + length)])
        columns["words"].append(rows.words[start : start + length])
        for c, values in zip(("n", "conv", "children", "leaves", "saved", "ends"), zip(*[x or nothing for x in paths[side]], strict=True), strict=True):
            columns[c].append(list(values))
    return _batch(len(sides), kind=[1] * len(sides), shard=[shard] * len(sides), side=sides, **columns)


def _convs_batch(rows: Rows, shard: int, conv_of: np.ndarray) -> pa.RecordBatch:
    """conv_ids along each row; null at the depths of which this shard has a part only, and on which path these lie."""
    open_ = conv_of >= _NONE - 1
    side = np.zeros(len(rows.lengths), np.int32)
    doc = np.repeat(np.arange(len(rows.lengths)), rows.lengths + 1)
    side[doc[conv_of == _NONE - 1]] = 1
    offsets = pa.array(np.append(rows.at, len(conv_of)).astype(np.int32))
    convs = pa.ListArray.from_arrays(offsets, pa.array(conv_of, mask=open_))
    n = len(rows.lengths)
    return _batch(n, kind=[2] * n, shard=[shard] * n, side=side, from_shard=rows.origin[0], from_side=rows.origin[1], convs=convs)


def level(rows: DataFrame, shards: int, label: str) -> DataFrame:
    """One step: rows dealt by ranges of their sequences into shards, and what these give."""
    closed = shards == 1
    dealt = rows.repartition(1) if closed else rows.repartitionByRange(shards, "names")

    def work(batches):
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if held:
            yield from nodes(Rows(pa.Table.from_batches(held)), TaskContext.get().partitionId(), closed)

    return keep(dealt.mapInArrow(work, _OUT), label)


def trie(rows: DataFrame, shard_turns: int = SHARD_TURNS, least_turns: int = LEAST_TURNS) -> DataFrame:
    """Nodes of the trie of distinct sequences (names, words, n, conv, ends)."""
    size = F.sum(F.size("words") + 1)

    def shards_for(turns: int) -> int:
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return max(-(-turns // shard_turns), min(tasks, -(-turns // least_turns)), 1)

    levels = []
    shards = shards_for(int(rows.agg(size).first()[0] or 0))
    while True:
        levels.append(level(rows, shards, "trie-level"))
        if shards == 1:
            break
        rows = levels[-1].filter("kind = 1").select(*[c.split(" ")[0] for c in _PATH.split(", ")], F.col("shard").alias("from_shard"), F.col("side").alias("from_side"))
        left = rows.agg(F.count("*").alias("n"), size.alias("turns")).first()
        # Two rows for each shard at most: a quarter of them halves the shards, so this ends.
        shards = 1 if (left["turns"] or 0) <= shard_turns else max(1, min(shards_for(left["turns"]), left["n"] // 4))
    found, known = [], None
    columns = [c.split(" ")[0] for c in _NODE.split(", ")]
    for at in reversed(range(len(levels))):
        own = levels[at].filter("kind = 0")
        if known is None:
            found.append(own.select(*columns))
        else:
            found.append(own.filter("side < 0").select(*columns))
            above = own.filter("side >= 0").join(known, ["shard", "side"], "left").withColumn("parent_conv_id", F.element_at("convs_of", F.col("depth").cast("int")))
            found.append(above.select(*columns))
        if at:
            paths = levels[at].filter("kind = 2").select("shard", "side", "from_shard", "from_side", "convs")
            convs: Column = F.col("convs")
            if known is not None:
                paths = paths.join(known, ["shard", "side"], "left")
                convs = F.transform("convs", lambda c, i: F.coalesce(c, F.get(F.col("convs_of"), i)))
            known = paths.select(F.col("from_shard").alias("shard"), F.col("from_side").alias("side"), convs.alias("convs_of"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def conversations(turns: DataFrame, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """Nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return trie(keep(sequences(rebuilt(turns, block, heads)), "sequences"))
