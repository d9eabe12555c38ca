"""Removal of repeated word windows by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words. Its minimiser is the least of its ``MINIMISER``-word hashes, in
an order that puts runs of words that are frequent in the corpus last. Consecutive windows with one
minimiser are a super-k-mer; equal windows always have equal minimisers, so counting within a
minimiser's bucket is exact.

1. Frequent runs: each task reports runs with more than its share; sums above ``FREQUENT`` of all runs
   are kept, at most 1 / ``FREQUENT`` of them, so what is broadcast is bounded whatever the input.
2. Minimisers are counted. Only super-k-mers whose minimiser occurs twice can hold a repeated window.
3. Texts that have such super-k-mers send them, each as one packed string, to the minimiser's bucket. There
   the windows are hashed to 128 bits, sorted and counted.
4. Repeated windows become word ranges of their text, and the text is cut.

Hot groups: within a round of work a task sends one row for equal minimisers (or equal packed strings)
with their number, and the rows that own them go on by a hash of their own, already known to repeat. A bucket thus gets
at most one row for each round and distinct string. Equal texts are one text with a number of copies.

Cases: null texts have no words. Repeated rows repeat each other's windows. Texts shorter than a window
lose nothing. Of equal minimisers in a window the first counts; which one it is changes no result. Very long texts are read whole;
one must fit a task's memory some ten times over. Extra columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import grouped, scatter, signed, whole_groups, with_keys
from tidemark.llm.text import Words, as_texts, grams, inside, least, mix, rounds
from tidemark.scratch import keep, keep_by

WINDOW = 35
MINIMISER = 6
FREQUENT = 1e-5
#: Runs that are counted before a task reports; few reports keep rare runs out of them.
ROUND_RUNS = 2_000_000
_TOP = np.uint64(1 << 63)
_OTHER_BASE = np.uint64(0xA24BAED4963EE407)


def counted_runs(docs: DataFrame, n: int, share: float, lower: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes of word runs that make up at least ``share`` of all runs, how often each occurs, and the number of all runs.

    There are at most 1 / share of them. ``lower`` takes A-Z as a-z.
    """

    def work(batches):
        for batch in batches:
            held, size = [], 0
            for part, texts in rounds(batch, "text"):
                words = Words(texts, lower)
                held.append(grams(words.hashes(), n)[inside(words.first, n)])
                size += len(held[-1])
                if size >= ROUND_RUNS:
                    yield told(np.concatenate(held))
                    held, size = [], 0
            if held:
                yield told(np.concatenate(held))

    def told(runs: np.ndarray) -> pa.RecordBatch:
        found, counts = np.unique(runs, return_counts=True)
        much = counts >= max(4, share / 2 * len(runs))
        found, counts = np.append(found[much], np.uint64(0)), np.append(counts[much], len(runs))
        total = np.append(np.zeros(much.sum(), bool), True)
        return pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(counts.astype(np.int64)), pa.array(total)], names=["run", "n", "total"])

    seen = docs.select("text").mapInArrow(work, "run long, n long, total boolean").groupBy("run", "total").agg(F.sum("n").alias("n"))
    seen = keep(seen, "frequent-runs")
    total = seen.filter("total").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = seen.filter((~F.col("total")) & (F.col("n") >= max(8.0, share * total))).select("run", "n").toPandas()
    runs = rows["run"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(runs)
    return runs[order], rows["n"].to_numpy(np.int64)[order], total


def frequent_runs(docs: DataFrame, n: int = MINIMISER, share: float = FREQUENT, lower: bool = False) -> np.ndarray:
    """The hashes that ``counted_runs`` tells."""
    return counted_runs(docs, n, share, lower)[0]


def super_kmers(words: Words, frequent: np.ndarray, window: int, m: int):
    """First window, number of windows and minimiser of each super-k-mer, in order of the words."""
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none, np.zeros(0, np.uint64)
    runs = grams(words.hashes(), m)
    value = runs >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, runs), len(frequent) - 1)
        value = np.where(frequent[at] == runs, value | _TOP, value)
    low = least(value, window - m + 1)
    ok = inside(words.first, window)
    low = low[: len(ok)]
    doc = words.doc()[: len(ok)]
    at = np.flatnonzero(ok)
    if not len(at):
        return none, none, np.zeros(0, np.uint64)
    # A new place begins a new one even where the hash is the same: else repeats within a text would hide.
    fresh = np.append(True, (low[at][1:] != low[at][:-1]) | (doc[at][1:] != doc[at][:-1]))
    heads = np.flatnonzero(fresh)
    counts = np.diff(np.append(heads, len(at)))
    return at[heads], counts, value[low[at[heads]]]


def _tally(values: np.ndarray):
    """For each value: index of its first place among equals, and how many equals there are."""
    _, first, inverse, counts = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
    return first, inverse, counts


def candidate_starts(docs: DataFrame, frequent, window: int, m: int) -> DataFrame:
    """(k1, k2, starts): super-k-mers, named by first word, whose minimiser occurs at least twice."""
    schema = "route long, n long, k1 long, k2 long, start int"

    def work(batches):
        for batch in batches:
            for part, texts in rounds(batch, "text"):
                words = Words(texts)
                first, _, minimiser = super_kmers(words, frequent.value, window, m)
                doc = words.doc()[first] if len(first) else first
                k1 = part.column("k1").to_numpy()[doc]
                k2 = part.column("k2").to_numpy()[doc]
                start = (first - words.first[doc]).astype(np.int32)
                _, inverse, counts = _tally(minimiser)
                many = counts[inverse] > 1
                # Known to repeat: the owners go anywhere, one row for all of them goes to the bucket.
                own = scatter(k1, k2, start)
                route = np.where(many, own, mix(minimiser))
                n = np.where(many, 0, 1)
                known = np.unique(minimiser[many])
                nothing = np.zeros(len(known), bool)
                mask = np.append(np.zeros(len(first), bool), ~nothing)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(np.append(route, mix(known)))),
                        pa.array(np.append(n, np.full(len(known), 2)).astype(np.int64)),
                        pa.array(np.append(k1, np.zeros(len(known), np.int64)), mask=mask),
                        pa.array(np.append(k2, np.zeros(len(known), np.int64)), mask=mask),
                        pa.array(np.append(start, np.zeros(len(known), np.int32)).astype(np.int32), mask=mask),
                    ],
                    names=["route", "n", "k1", "k2", "start"],
                )

    rows = docs.select("k1", "k2", "text").mapInArrow(work, schema)
    both = rows.withColumn("all", F.sum("n").over(Window.partitionBy("route")))
    found = both.filter(F.col("k1").isNotNull() & ((F.col("n") == 0) | (F.col("all") > 1)))
    return found.groupBy("k1", "k2").agg(F.collect_set("start").alias("starts"))


def repeated_ranges(texts: DataFrame, frequent, window: int, m: int) -> DataFrame:
    """(k1, k2, lo, hi): word ranges covered by repeated windows, for (k1, k2, text, copies, starts)."""
    schema = "route long, n long, packed binary, k1 long, k2 long, start int, windows int"

    def send(batches):
        for batch in batches:
            for part, found in rounds(batch, "text"):
                words = Words(found)
                first, count, minimiser = super_kmers(words, frequent.value, window, m)
                doc = words.doc()[first] if len(first) else first
                start = first - words.first[doc]
                starts = part.column("starts")
                wanted = np.repeat(np.arange(part.num_rows), starts.value_lengths().fill_null(0).to_numpy())
                pairs = set(zip(wanted.tolist(), starts.flatten().to_pylist(), strict=True))
                use = np.array([x in pairs for x in zip(doc.tolist(), start.tolist(), strict=True)], dtype=bool)
                first, count, minimiser, doc, start = first[use], count[use], minimiser[use], doc[use], start[use]
                copies = part.column("copies").to_numpy()[doc]
                text = words.data.tobytes()
                a, b = words.starts.tolist(), words.ends.tolist()
                packed = [b" ".join(text[a[f] : b[f + c + window - 2]].split()) for f, c in zip(first.tolist(), count.tolist(), strict=True)]
                total: dict[bytes, int] = {}
                for p, c in zip(packed, copies.tolist(), strict=True):
                    total[p] = total.get(p, 0) + c
                k1, k2 = part.column("k1").to_numpy()[doc], part.column("k2").to_numpy()[doc]
                many = np.array([total[p] > 1 for p in packed], dtype=bool)
                known = {p: i for i, p in enumerate(packed) if many[i]}
                again = np.array(list(known.values()), dtype=np.int64)
                route = np.where(many, scatter(k1, k2, start), mix(minimiser))
                mask = np.append(np.zeros(len(packed), bool), np.ones(len(again), bool))
                pick = np.append(np.arange(len(packed)), again).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(np.append(route, mix(minimiser[again])))),
                        pa.array(np.append(np.where(many, 0, 1), np.full(len(again), 2)).astype(np.int64)),
                        pa.array([None if many[i] else p for i, p in enumerate(packed)] + list(known), pa.binary()),
                        pa.array(k1[pick], mask=mask),
                        pa.array(k2[pick], mask=mask),
                        pa.array(start[pick].astype(np.int32), mask=mask),
                        pa.array(count[pick].astype(np.int32)),
                    ],
                    names=["route", "n", "packed", "k1", "k2", "start", "windows"],
                )

    def count(batches):
        for table in whole_groups(batches, "route"):
            table = table.combine_chunks()
            n = table.column("n").to_numpy()
            owned = ~np.asarray(table.column("k1").is_null())
            k1, k2 = (table.column(c).fill_null(0).to_numpy() for c in ("k1", "k2"))
            start = table.column("start").fill_null(0).to_numpy().astype(np.int64)
            lo, hi, owner = [start[n == 0]], [start[n == 0] + table.column("windows").to_numpy()[n == 0] + window - 1], [np.flatnonzero(n == 0)]
            at = np.flatnonzero(n > 0)
            if len(at):
                words = Words(as_texts(table.column("packed").combine_chunks().take(pa.array(at)).cast(pa.string())))
                hashes = words.hashes()
                ok = inside(words.first, window)
                h1, h2 = grams(hashes, window)[ok], grams(hashes, window, _OTHER_BASE)[ok]
                row = words.doc()[: len(ok)][ok]
                place = (np.arange(len(ok)) - words.first[words.doc()[: len(ok)]])[ok]
                order = np.lexsort((h2, h1))
                s1, s2, weight = h1[order], h2[order], n[at][row[order]]
                fresh = np.append(True, (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1]))
                sums = np.add.reduceat(weight, np.flatnonzero(fresh))
                often = sums[np.cumsum(fresh) - 1] > 1
                hit = order[often]
                hit = hit[owned[at[row[hit]]]]
                hit.sort()
                r, p = row[hit], place[hit]
                head = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1))) if len(hit) else hit
                tail = np.append(head[1:], len(hit)) - 1 if len(hit) else hit
                lo.append(start[at[r[head]]] + p[head])
                hi.append(start[at[r[head]]] + p[tail] + window)
                owner.append(at[r[head]])
            who = np.concatenate(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[who]), pa.array(k2[who]), pa.array(np.concatenate(lo).astype(np.int32)), pa.array(np.concatenate(hi).astype(np.int32))],
                names=["k1", "k2", "lo", "hi"],
            )

    sent = texts.select("k1", "k2", "text", "copies", "starts").mapInArrow(send, schema)
    return grouped(sent, "route").mapInArrow(count, "k1 long, k2 long, lo int, hi int")


def _cut(texts: DataFrame) -> DataFrame:
    """(k1, k2, n_removed, kept) of (k1, k2, text, ranges)."""

    def work(batches):
        for batch in batches:
            for part, found in rounds(batch, "text"):
                words = Words(found)
                ranges = part.column("ranges")
                flat = ranges.flatten()
                doc = np.repeat(np.arange(part.num_rows), ranges.value_lengths().fill_null(0).to_numpy())
                at = words.first[doc]
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, at + flat.field("lo").to_numpy(), 1)
                np.add.at(step, at + flat.field("hi").to_numpy(), -1)
                gone = np.cumsum(step[:-1]) > 0
                text, a, b = words.data.tobytes(), words.starts, words.ends
                removed, kept = [], []
                for i in range(part.num_rows):
                    own = slice(words.first[i], words.first[i + 1])
                    stay = ~gone[own]
                    removed.append(int((~stay).sum()))
                    kept.append(b" ".join(text[x:y] for x, y in zip(a[own][stay].tolist(), b[own][stay].tolist(), strict=True)).decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column("k1"), part.column("k2"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    names=["k1", "k2", "n_removed", "kept"],
                )

    return texts.select("k1", "k2", "text", "ranges").mapInArrow(work, "k1 long, k2 long, n_removed long, kept string")


def repeated(docs: DataFrame, window: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """Texts that lose words: (k1, k2, n_removed, kept), one row for each distinct text."""
    m = min(m, window)
    keyed = with_keys(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_runs(docs.select("text"), m))
    starts = candidate_starts(keyed, frequent, window, m)
    texts = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    able = keep_by(texts.join(starts, ["k1", "k2"]), "repeated-texts", "k1", "k2")
    ranges = repeated_ranges(able, frequent, window, m)
    ranges = keep(ranges.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), "repeated-ranges")
    return _cut(able.select("k1", "k2", "text").join(ranges, ["k1", "k2"]))


def whole(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n_words, whole_sha256) of each row, without any removal."""

    def work(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            words = [t.encode().split() for t in texts]
            sha = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array([len(w) for w in words], pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "k1", "k2", "n_words", "whole_sha256"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    rows = with_keys(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    return rows.select("doc_id", "k1", "k2", "text").mapInArrow(work, f"doc_id {kind}, k1 long, k2 long, n_words long, whole_sha256 string")


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    lost = repeated(docs, window).select("k1", "k2", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("sha"))
    lost = keep(lost, "repeated-results")
    return (
        whole(docs)
        .join(lost, ["k1", "k2"], "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
            F.coalesce("sha", "whole_sha256").alias("kept_sha256"),
        )
    )
