"""Removal of byte strings that an earlier document holds, by prefix doubling on a sparse suffix set.

Ranks are names of prefixes: equal prefixes, equal names. Suffixes are first named by ``HALF`` bytes; the
suffixes whose name is unique are done, as no longer prefix can repeat. Those left are paired with the
rank ``HALF`` bytes further on, which names ``2 * HALF`` bytes, the length that counts. All suffixes of
a corpus at 16 bytes each would be many times the corpus, so the first rounds run on a sparse set that
misses nothing: of the ``HALF`` + 1 half-names inside a string of ``LENGTH`` bytes the least is its anchor
(the first of equals), and equal strings have equal anchors.

Round 0  Names of anchors are counted over the corpus. A unique anchor retires its strings.
Round 1  The strings of an anchor form one stretch of at most LENGTH + HALF bytes, named by the pair of the
         ranks at its two ends. A stretch that a smaller doc_id holds goes at once. An anchor with one
         stretch only is settled.
Round 2  Anchors with several stretches (the edges of repeats) pair the ranks of every string at offset
         HALF; a string that a smaller doc_id holds goes.

A chunk is the set of texts with one value of k1 modulo the number of chunks. It sends one packed row to
each bucket of names, each name once, and gets one packed answer, so what is moved is some bytes for each
anchor, and a string that a third of the documents share weighs one entry for each chunk. Texts are
shuffled once, to their chunk; copies of a text that one task reads travel as one.

Cases: a null text is empty. Of equal texts those with the smallest doc_id stand for all; the others lose
every byte if the text has ``LENGTH`` bytes. A null doc_id counts as larger than any; rows with equal
doc_id do not hold anything before each other. Very long texts are read whole; one must fit a task's memory some ten times over. Extra columns do not matter; empty tables give empty
results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import with_keys
from tidemark.llm.text import _BYTE, _STEP, ROUND_BYTES, Texts, as_texts, least, mix, powers
from tidemark.scratch import keep

LENGTH = 50
#: Raw bytes for each bucket of names, and least and most raw bytes of a chunk of texts.
BUCKET_BYTES = 8 << 20
CHUNK_BYTES = (512 << 10, 64 << 20)
_LAST = np.iinfo(np.int64).max


def rolling(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive bytes, unmixed, so that hash(a + b) = hash(a) * STEP ** len(b) + hash(b)."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    power = powers(_STEP, n + 1)
    total, have = None, 0
    piece, width = _BYTE[data], 1
    while True:
        if n & width:
            if total is None:
                total, have = piece, width
            else:
                size = len(data) - have - width + 1
                total = total[:size] * power[width] + piece[have : have + size]
                have += width
        if width * 2 > n:
            return total
        piece = piece[:-width] * power[width] + piece[width:]
        width *= 2


class Anchors:
    """Stretches of texts: text index, first and last string (offsets in the text), anchor and stretch names."""

    def __init__(self, column: pa.Array, length: int):
        self.length, half = length, length // 2
        whole = as_texts(column)
        self.texts = whole
        doc, lo, hi, name, stretch = [], [], [], [], []
        i = 0
        while i < len(whole):
            j = max(i + 1, int(np.searchsorted(whole.offsets, whole.offsets[i] + ROUND_BYTES, side="right")) - 1)
            part = Texts(whole.data[whole.offsets[i] : whole.offsets[j]], whole.offsets[i : j + 1] - whole.offsets[i])
            found = self._round(part, half)
            if found is not None:
                d, a, b, n, s = found
                doc.append(d + i)
                lo.append(a)
                hi.append(b)
                name.append(n)
                stretch.append(s)
            i = j
        none = np.zeros(0, np.int64)
        self.doc, self.lo, self.hi = (np.concatenate(x) if x else none for x in (doc, lo, hi))
        self.name, self.stretch = (np.concatenate(x) if x else none.view(np.uint64) for x in (name, stretch))

    def _round(self, part: Texts, half: int):
        length, data, offsets = self.length, part.data, part.offsets
        sizes = np.diff(offsets)
        if not (sizes >= length).any():
            return None
        ranks = rolling(data, half)
        names = mix(ranks)
        places = length - half + 1
        bits = int(len(names)).bit_length()
        if bits <= 24:
            low = (names >> np.uint64(24) << np.uint64(24)) | np.arange(len(names), dtype=np.uint64)
            width = 1
            while width < places:
                step = min(width, places - width)
                low = np.minimum(low[: len(low) - step], low[step:])
                width += step
            at = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        else:
            at = least(names >> np.uint64(24), places)
        # Where strings of a text start; the first of each run with one anchor begins a stretch.
        ok = np.zeros(len(at) + 1, np.int32)
        long = sizes >= length
        np.add.at(ok, offsets[:-1][long], 1)
        np.add.at(ok, offsets[1:][long] - length + 1, -1)
        ok = np.cumsum(ok[:-1]) > 0
        fresh = ok.copy()
        fresh[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
        fresh[offsets[:-1][long]] = True
        final = ok.copy()
        final[:-1] &= fresh[1:] | ~ok[1:]
        a, b = np.flatnonzero(fresh), np.flatnonzero(final)
        doc = np.searchsorted(offsets, a, side="right") - 1
        far = powers(_STEP, half + 1)[half] if length == 2 * half else None
        ends = self._full(ranks, a, half, far, data), self._full(ranks, b, half, far, data)
        stretch = mix(mix(ends[0]) * np.uint64(0x9E3779B97F4A7C15) + ends[1] + (b - a).astype(np.uint64))
        # Least names crowd at the low end: mixed again, they fill the buckets evenly.
        return doc, a - offsets[doc], b - offsets[doc], mix(names[at[a]] + _STEP), stretch

    def _full(self, ranks, at, half, far, data):
        """Names of the strings that start at ``at``: the pair of ranks ``half`` apart, and an odd byte."""
        if far is not None:
            return ranks[at] * far + ranks[at + half]
        return (ranks[at] * powers(_STEP, half + 1)[half] + ranks[at + half]) * _STEP + _BYTE[data[at + 2 * half]]

    def strings(self, pick: np.ndarray):
        """Text, offset and name of every string of the chosen stretches."""
        half = self.length // 2
        count = (self.hi - self.lo + 1)[pick]
        doc = np.repeat(self.doc[pick], count)
        first = np.repeat(self.lo[pick], count)
        ends = np.cumsum(count)
        offset = first + np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count)
        names = np.zeros(len(doc), np.uint64)
        far = powers(_STEP, half + 1)[half] if self.length == 2 * half else None
        # Texts of the chosen stretches, one round of texts at a time.
        order = np.argsort(doc, kind="stable")
        heads = np.searchsorted(doc[order], np.arange(len(self.texts) + 1))
        for d in np.unique(doc):
            own = order[heads[d] : heads[d + 1]]
            data = self.texts.data[self.texts.offsets[d] : self.texts.offsets[d + 1]]
            names[own] = self._full(rolling(data, half), offset[own], half, far, data)
        return doc, offset, mix(names ^ np.uint64(0x5BF03635F0A31F2D))


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    """Grows with the name, so that sorted names are sorted by bucket."""
    return ((names >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _edges(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.zeros(0, np.int64)


class Chunk:
    """The distinct texts of a chunk in order of their keys, with the least doc_id of each."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("k1", "ascending"), ("k2", "ascending"), ("text", "ascending")])
        k1, k2 = table.column("k1").to_numpy(), table.column("k2").to_numpy()
        heads = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))) if len(k1) else np.zeros(0, np.int64)
        self.k1, self.k2 = k1[heads], k2[heads]
        self.id = np.minimum.reduceat(table.column("id").to_numpy(), heads) if len(heads) else np.zeros(0, np.int64)
        texts = table.column("text").take(pa.array(heads)).combine_chunks()
        self.texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        self.number = int(table.column("chunk")[0].as_py())


class Names:
    """Distinct names of a chunk in order, and for each of its items the index of its name."""

    def __init__(self, names: np.ndarray, buckets: int, second: np.ndarray | None = None):
        order = np.lexsort((second, names)) if second is not None else np.argsort(names, kind="stable")
        s = names[order]
        fresh = np.append(True, s[1:] != s[:-1]) if len(s) else np.zeros(0, bool)
        if second is not None and len(s):
            t = second[order]
            fresh[1:] |= t[1:] != t[:-1]
        self.order, self.heads = order, np.flatnonzero(fresh)
        self.names = s[self.heads]
        self.second = second[order][self.heads] if second is not None else None
        self.index = np.empty(len(s), np.int64)
        self.index[order] = np.cumsum(fresh) - 1
        self.bucket = bucket_of(self.names, buckets)

    def least(self, values: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(values[self.order], self.heads) if len(self.heads) else values[:0]

    def most(self, values: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(values[self.order], self.heads) if len(self.heads) else values[:0]

    def rows(self, chunk: int, **columns: np.ndarray) -> pa.Table:
        """One row for each bucket: the entries of each column as packed bytes."""
        cuts = np.append(_edges(self.bucket), len(self.bucket))
        ranges = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        data = {
            "bucket": pa.array(self.bucket[cuts[:-1]], pa.int64()),
            "chunk": pa.array(np.full(len(ranges), chunk), pa.int64()),
        }
        for name, values in columns.items():
            data[name] = pa.array([values[a:b].tobytes() for a, b in ranges], pa.binary())
        return pa.table(data)

    def answers(self, table: pa.Table) -> np.ndarray:
        """The answer bytes of the chunk, entry by entry."""
        if not table.num_rows:
            return np.zeros(0, np.uint8)
        table = table.sort_by("bucket")
        return np.frombuffer(b"".join(table.column("answer").to_pylist()), dtype=np.uint8)


def _unpacked(table: pa.Table, *columns: tuple[str, type]):
    lists = [[np.frombuffer(x, dtype=kind) for x in table.column(name).to_pylist()] for name, kind in columns]
    sizes = [len(x) for x in lists[0]]
    return sizes, [np.concatenate(x) for x in lists]


def _answered(table: pa.Table, sizes: list[int], answer: np.ndarray) -> pa.Table:
    cuts = np.cumsum([0, *sizes]).tolist()
    answer = answer.astype(np.uint8)
    packed = [answer[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "answer": pa.array(packed, pa.binary())})


_ANSWER = "chunk long, bucket long, answer binary"


def _six(names: np.ndarray) -> np.ndarray:
    """The low six bytes of each name; with the bucket they tell names apart well enough to count anchors."""
    return np.ascontiguousarray(names.view(np.uint8).reshape(-1, 8)[:, :6])


def _count(table: pa.Table) -> pa.Table:
    """Round 0: whether an anchor occurs in more than one text."""
    raw = [np.frombuffer(x, np.uint8).reshape(-1, 6) for x in table.column("names").to_pylist()]
    many = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("many").to_pylist()])
    six = np.concatenate(raw)
    names = np.zeros((len(six), 8), np.uint8)
    names[:, :6] = six
    names = names.view(np.uint64).ravel()
    order = np.argsort(names, kind="stable")
    s = names[order]
    fresh = np.append(True, s[1:] != s[:-1])
    total = np.add.reduceat(1 + many[order].astype(np.int64), np.flatnonzero(fresh))
    answer = np.zeros(len(names), np.uint8)
    answer[order] = (total > 1)[np.cumsum(fresh) - 1]
    return _answered(table, [len(x) for x in raw], answer)


def _settle(table: pa.Table) -> pa.Table:
    """Round 1: 1 if a smaller doc_id holds the stretch, plus 2 if the anchor has several stretches."""
    sizes, (names, stretch, ids) = _unpacked(table, ("names", np.uint64), ("stretch", np.uint64), ("ids", np.int64))
    order = np.lexsort((stretch, names))
    n, t = names[order], stretch[order]
    new_name = np.append(True, n[1:] != n[:-1])
    new = new_name.copy()
    new[1:] |= t[1:] != t[:-1]
    smallest = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    stretches = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_name))[np.cumsum(new_name) - 1]
    answer = np.zeros(len(names), np.uint8)
    answer[order] = (smallest < ids[order]) + 2 * (stretches > 1)
    return _answered(table, sizes, answer)


def _smaller(table: pa.Table) -> pa.Table:
    """Round 2: 1 if a smaller doc_id holds the string."""
    sizes, (names, ids) = _unpacked(table, ("names", np.uint64), ("ids", np.int64))
    order = np.argsort(names, kind="stable")
    fresh = np.append(True, names[order][1:] != names[order][:-1])
    smallest = np.minimum.reduceat(ids[order], np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
    answer = np.zeros(len(names), np.uint8)
    answer[order] = smallest < ids[order]
    return _answered(table, sizes, answer)


def _by_chunk(docs: DataFrame, chunks: int) -> DataFrame:
    """(chunk, k1, k2, id, text): each text once for each task that reads it; later rows without the text
    only where they have a smaller doc_id."""

    def work(batches):
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            k1, k2, ids = (batch.column(c).to_pylist() for c in ("k1", "k2", "id"))
            rows, first = [], []
            for i, (a, b, d) in enumerate(zip(k1, k2, ids, strict=True)):
                old = seen.get((a, b))
                if old is None or d < old:
                    seen[(a, b)] = d
                    rows.append(i)
                    first.append(old is None)
            part = batch.take(pa.array(rows, pa.int64()))
            import pyarrow.compute as pc

            text = pc.if_else(pa.array(first, pa.bool_()), part.column("text"), pa.scalar(None, part.column("text").type))
            chunk = np.mod(part.column("k1").to_numpy(), chunks)
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk), part.column("k1"), part.column("k2"), part.column("id"), text], names=["chunk", "k1", "k2", "id", "text"]
            )

    return docs.select("k1", "k2", "id", "text").mapInArrow(work, "chunk long, k1 long, k2 long, id long, text string")


def _walk(length: int, buckets: int, last: int):
    """What a chunk does with the answers of the rounds before ``last``: it sends, or, after round 2, cuts."""

    def repeats(anchors: Anchors, ids: np.ndarray, answers: pa.Table):
        def of(step: int) -> pa.Table:
            import pyarrow.compute as pc

            return answers.filter(pc.equal(answers.column("step"), step))

        names = Names(anchors.name, buckets)
        if last == 0:
            low, high = names.least(anchors.doc), names.most(anchors.doc)
            return names, {"names": _six(names.names), "many": (low != high).astype(np.uint8)}
        live = np.flatnonzero(names.answers(of(0))[names.index] > 0) if len(names.index) else np.zeros(0, np.int64)
        own = ids[anchors.doc[live]]
        pairs = Names(anchors.name[live], buckets, anchors.stretch[live])
        held = pairs.least(own)
        if last == 1:
            return pairs, {"names": pairs.names, "stretch": pairs.second, "ids": held}
        said = pairs.answers(of(1))
        gone = ((said[pairs.index] & 1) > 0) | (held[pairs.index] < own) if len(live) else np.zeros(0, bool)
        edge = live[~gone & (said[pairs.index] >= 2)] if len(live) else live
        doc, offset, name = anchors.strings(edge)
        strings = Names(name, buckets)
        mine = ids[doc]
        first = strings.least(mine)
        if last == 2:
            return strings, {"names": strings.names, "ids": first}
        told = strings.answers(of(2))
        cut = (told[strings.index] > 0) | (first[strings.index] < mine) if len(doc) else np.zeros(0, bool)
        whole = live[gone]
        return (
            np.append(anchors.doc[whole], doc[cut]),
            np.append(anchors.lo[whole], offset[cut]),
            np.append(anchors.hi[whole] + length, offset[cut] + length),
        )

    def send(chunk: Chunk, answers: pa.Table) -> pa.Table:
        names, columns = repeats(Anchors(chunk.texts, length), chunk.id, answers)
        return names.rows(chunk.number, **columns)

    def cut(chunk: Chunk, answers: pa.Table) -> pa.Table:
        anchors = Anchors(chunk.texts, length)
        doc, lo, hi = repeats(anchors, chunk.id, answers)
        texts = anchors.texts
        step = np.zeros(len(texts.data) + 1, np.int32)
        np.add.at(step, texts.offsets[doc] + lo, 1)
        np.add.at(step, texts.offsets[doc] + hi, -1)
        gone = np.cumsum(step[:-1]) > 0
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        heads = texts.offsets[:-1]
        inner = heads[heads < len(gone)]
        starts[inner] = gone[inner]
        removed, spans = (np.append(0, np.cumsum(x)) for x in (gone, starts))
        kept = texts.data[~gone].tobytes()
        at = texts.offsets - removed[texts.offsets]
        return pa.table(
            {
                "k1": pa.array(chunk.k1),
                "k2": pa.array(chunk.k2),
                "first_id": pa.array(chunk.id),
                "n_removed": pa.array(np.diff(removed[texts.offsets]).astype(np.int64)),
                "n_spans": pa.array(np.diff(spans[texts.offsets]).astype(np.int64)),
                "kept": pa.array([kept[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary()),
            }
        )

    return cut if last == 3 else send


_SENT = {
    0: "bucket long, chunk long, names binary, many binary",
    1: "bucket long, chunk long, names binary, stretch binary, ids binary",
    2: "bucket long, chunk long, names binary, ids binary",
    3: "k1 long, k2 long, first_id long, n_removed long, n_spans long, kept binary",
}


def _alone(work):
    def of(table: pa.Table) -> pa.Table:
        return work(Chunk(table), None)

    return of


def _answering(work, schema: str):
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    empty = pa.table({name: pa.array([], kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))})

    def of(texts: pa.Table, answers: pa.Table) -> pa.Table:
        return work(Chunk(texts), answers) if texts.num_rows else empty

    return of


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, first_id, n_removed, n_spans, kept) of each distinct text, as its first document sees it."""
    rows = with_keys(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.coalesce("text", F.lit("")).alias("text")))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    size = min(max(CHUNK_BYTES[0], total // 2000), CHUNK_BYTES[1])
    chunks, buckets = max(1, -(-total // size)), max(64, -(-total // BUCKET_BYTES))
    texts = _by_chunk(rows, chunks)
    answers: DataFrame | None = None
    for step, judge in enumerate([_count, _settle, _smaller, None]):
        work = _walk(length, buckets, step)
        if answers is None:
            sent = texts.groupBy("chunk").applyInArrow(_alone(work), _SENT[step])
        else:
            sent = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_answering(work, _SENT[step]), _SENT[step])
        if judge is None:
            return sent
        told = sent.groupBy("bucket").applyInArrow(judge, _ANSWER).withColumn("step", F.lit(step))
        answers = told if answers is None else answers.unionByName(told)
    raise AssertionError


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    cut = repeated(docs, length).withColumn("sha", F.sha2("kept", 256)).drop("kept")
    cut = keep(cut, "suffix-results")
    rows = with_keys(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    rows = rows.select("doc_id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"))
    copy = (F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)) > F.col("first_id")) & (F.col("n_bytes") >= length)
    return rows.join(cut, ["k1", "k2"], "left").select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("sha")).alias("kept_sha256"),
    )
