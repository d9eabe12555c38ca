"""Language-model scoring with a probabilistic suffix tree over bytes.

A text is the sequence of its words, A-Z lower-cased, each followed by a space, and an end mark. The
tree holds contexts of up to ``DEPTH`` earlier symbols, across words. A context becomes a state if the
divergence of its next-symbol counts from those of its shorter suffix outweighs what it costs to describe
them; it must occur ``LEAST`` times, however large the corpus, and there is no limit to the number of states.
Distributions are smoothed towards the nearest shorter state. Each symbol is scored in the longest state that
is a suffix of what precedes it. Scores are log10 probabilities of one distribution over all texts.

Symbols of a context are classes of bytes: the ``CLASSES`` - 1 most frequent bytes have one each, the
rest share one. Counts come from every training text and are summed before and after the shuffle. The tree
is a table of the values of context and next symbol, grown in parts: contexts that end in the same two symbols
lie together with all their suffixes of three symbols or more. Only what two symbols tell, at most CLASSES ** 3
numbers, comes to the driver. Texts are cut into pieces of about ``PIECE`` bytes; a piece asks the table for the
pairs that occur in it, so what moves is a row for each piece and distinct pair.

The base score needs the count of every word. Words with at least a 1 / ``COMMON`` share of the tokens
are broadcast (at most COMMON of them), and so are words of which scored texts ask that often, such as those that only held-out
texts have; the rest, of which none is hot on either side, are joined.

Cases: a null text is empty and has one token, the end. Repeated rows count each. With no training text
N, V and all counts are 0 and the tree is uniform. A null doc_id is never held out. Extra columns do not
matter; an empty table gives an empty result. Very long texts are read whole; one makes a piece of its own. Of equally
frequent bytes the smaller has the smaller class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import grouped, signed, whole_groups
from tidemark.llm.language import held_out
from tidemark.llm.text import SPACE, Texts, Words, rounds
from tidemark.scratch import drop, keep, keep_by

DEPTH = 5
BITS = 6
CLASSES = 1 << BITS
LEAST = 2
#: Symbols of a context that all processes know the counts of.
TOP = 2
PIECE = 16 << 20
COMMON = 1 << 21
PULL = 4.0
_END, _GAP = 0x0A, 0x20


def stream(texts: Texts, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each as DEPTH end marks, its words with a space after each, and an end mark; heads of texts."""
    lengths = words.ends - words.starts
    doc = words.doc()
    size = np.bincount(doc, lengths + 1, minlength=len(texts)).astype(np.int64)
    heads = np.append(0, np.cumsum(size + DEPTH + 1))
    out = np.full(int(heads[-1]), _END, np.uint8)
    before = np.append(0, np.cumsum(lengths + 1))
    at = before[:-1] - before[words.first[:-1]][doc] + heads[:-1][doc] + DEPTH
    solid = words.data[~SPACE[words.data]]
    skipped = np.append(0, np.cumsum(lengths))[:-1]
    out[np.arange(len(solid)) + np.repeat(at - skipped, lengths)] = solid
    out[at + lengths] = _GAP
    return out, heads


def padding(heads: np.ndarray) -> np.ndarray:
    """Places of the end marks before texts, which are context only."""
    return (heads[:-1, None] + np.arange(DEPTH)).ravel()


def contexts(classes: np.ndarray) -> np.ndarray:
    """Number of the DEPTH symbols before each place from DEPTH on, the latest in the low bits."""
    wide = classes.astype(np.int64)
    code = np.zeros(len(wide) - DEPTH, np.int64)
    for back in range(1, DEPTH + 1):
        code |= wide[DEPTH - back : len(wide) - back] << (BITS * (back - 1))
    return code


def word_counts(train: DataFrame) -> DataFrame:
    """(kind, item, n): kind 0 words by hash, kind 1 bytes of the streams, kind 2 texts."""

    def work(batches):
        for batch in batches:
            held, sums, texts_seen = [], np.zeros(256, np.int64), 0
            for part, texts in rounds(batch, "text"):
                words = Words(texts, lower=True)
                held.append(np.unique(words.hashes(), return_counts=True))
                sums += np.bincount(stream(texts, words)[0], minlength=256)
                texts_seen += part.num_rows
            if not held:
                continue
            names, counts = merged(held)
            kind = np.concatenate([np.zeros(len(names)), np.ones(256), [2]]).astype(np.int32)
            item = np.concatenate([signed(names), np.arange(256), [0]])
            n = np.concatenate([counts, sums, [texts_seen]])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(item), pa.array(n)], names=["kind", "item", "n"])

    return train.select("text").mapInArrow(work, "kind int, item long, n long").groupBy("kind", "item").agg(F.sum("n").alias("n"))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    names, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(names):
        return names, counts.astype(np.int64)
    order = np.argsort(names, kind="stable")
    names, counts = names[order], counts[order]
    heads = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
    return names[heads], np.add.reduceat(counts.astype(np.int64), heads)


def known(names: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are among the sorted names, and where."""
    if not len(names):
        return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
    return names[at] == hashes, at


def symbols(byte_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte, and log10 share of each byte in its class."""
    order = np.argsort(-byte_counts, kind="stable")
    classes = np.full(256, CLASSES - 1, np.uint8)
    classes[order[: CLASSES - 1]] = np.arange(CLASSES - 1)
    rest = classes == CLASSES - 1
    share = np.zeros(256)
    share[rest] = np.log10((byte_counts[rest] + 1) / (byte_counts[rest] + 1).sum())
    return classes, share


def deepen(names: np.ndarray, n: np.ndarray, shorter_n: np.ndarray, shorter_total: np.ndarray, shorter_value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count of the context and probability, of contexts with next symbols and their counts.

    ``shorter_``: the same of the context without its earliest symbol, for each name.
    """
    context, of = np.unique(names >> BITS, return_inverse=True)
    total = np.bincount(of, n, minlength=len(context))
    p = (shorter_n + 0.5) / (shorter_total + 0.5 * CLASSES)
    divergence = np.bincount(of, n * np.log2(np.where(n > 0, n / np.maximum(total, 1)[of] / p, 1)), minlength=len(context))
    gain = divergence - 0.5 * np.log2(total + 1) * np.bincount(of, n > 0, minlength=len(context))
    state = (gain > 0) & (total >= LEAST)
    return total[of], np.where(state[of], (n + PULL * shorter_value) / (total[of] + PULL), shorter_value)


def top(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, counts of the context, and probabilities for TOP symbols of context and a next one, by their number."""
    counts = [n.astype(np.float64)]
    while len(counts[0]) > CLASSES:
        counts.insert(0, counts[0].reshape(CLASSES, -1).sum(axis=0))
    before = counts[0] + 1
    total = np.full(CLASSES, before.sum())
    value = before / total
    for own in counts[1:]:
        names = np.arange(len(own))
        short = names % len(before)
        total, value = deepen(names, own, before[short], total[short], value[short])
        before = own
    return before, total, value


def leaves(codes: np.ndarray, n: np.ndarray, above: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their log10 probabilities; with a code all that share its last TOP symbols are there."""
    names = np.arange(len(above[0]))
    before, total, value = above
    for depth in range(TOP + 1, DEPTH + 1):
        own, inverse = np.unique(codes & ((1 << BITS * (depth + 1)) - 1), return_inverse=True)
        counts = np.bincount(inverse, n, minlength=len(own))
        short = np.searchsorted(names, own & ((1 << BITS * depth) - 1))
        total, value = deepen(own, counts, before[short], total[short], value[short])
        names, before = own, counts
    return names, np.log10(value)


def places(data: np.ndarray, heads: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of context and symbol for each place from DEPTH on, and which places are not padding."""
    own = classes[data]
    ok = np.ones(len(own), bool)
    ok[padding(heads)] = False
    return (contexts(own) << BITS) | own[DEPTH:], ok[DEPTH:]


def pieces(rows: DataFrame) -> DataFrame:
    """``rows`` with the number of their piece, written once, so that a piece stays what it is."""

    def work(batches):
        task, piece, size = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for part, texts in rounds(batch, "text"):
                number = pa.array(np.full(part.num_rows, (task << 32) | piece, np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, number], names=[*part.schema.names, "piece"])
                size += len(texts.data)
                if size >= PIECE:
                    piece, size = piece + 1, 0

    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return keep_by(rows.mapInArrow(work, f"{schema}, piece long"), "tree-texts", "piece")


def asked(cut: DataFrame, classes: np.ndarray) -> DataFrame:
    """(piece, code, n): codes that occur in a piece and how often in its training texts."""
    shared = cut.sparkSession.sparkContext.broadcast(classes)

    def said(piece, held):
        codes, counts = merged(held)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), piece, np.int64)), pa.array(codes), pa.array(counts)], names=["piece", "code", "n"])

    def work(batches):
        last, held = None, []
        for batch in batches:
            numbers = batch.column("piece").to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])), len(numbers)).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if numbers[a] != last and held:
                    yield said(last, held)
                    held = []
                last = numbers[a]
                for part, texts in rounds(batch.slice(a, b - a), "text"):
                    data, heads = stream(texts, Words(texts, lower=True))
                    codes, ok = places(data, heads, shared.value)
                    train = np.repeat(~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool), np.diff(heads))[DEPTH:]
                    held.append(np.unique(codes[ok & train], return_counts=True))
                    only = np.unique(codes[ok & ~train])
                    held.append((only, np.zeros(len(only), np.int64)))
        if held:
            yield said(last, held)

    return keep(cut.select("piece", "held_out", "text").mapInArrow(work, "piece long, code long, n long"), "tree-asked")


def grow(counts: DataFrame) -> DataFrame:
    """(code, value): log10 probability of the next symbol in the longest state, for each code of ``counts``."""
    short = F.col("code").bitwiseAND(F.lit((1 << BITS * (TOP + 1)) - 1))
    # At most CLASSES ** (TOP + 1) rows.
    known_top = counts.groupBy(short.alias("code")).agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(1 << BITS * (TOP + 1))
    n[known_top.column("code").to_numpy()] = known_top.column("n").to_numpy()
    above = counts.sparkSession.sparkContext.broadcast(top(n))

    def work(batches):
        for table in whole_groups(batches, "suffix", 50_000):
            codes, value = leaves(table.column("code").to_numpy(), table.column("n").to_numpy(), above.value)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(value.astype(np.float32))], names=["code", "value"])

    suffix = F.shiftright("code", BITS).bitwiseAND(F.lit((1 << BITS * TOP) - 1))
    return grouped(counts.withColumn("suffix", suffix), "suffix").mapInArrow(work, "code long, value float")


def score(docs: DataFrame, buckets: int = 7, bucket: int = 2) -> DataFrame:
    """The columns of the query for each row, learning from the rows outside ``bucket`` of ``buckets``."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("held_out", held_out(buckets, bucket))
    train = rows.filter(~F.col("held_out")).select("text")
    seen = keep(word_counts(train), "word-counts")
    vocabulary = seen.filter("kind = 0").select(F.col("item").alias("word"), F.col("n").alias("count"))
    words, distinct = vocabulary.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    byte_counts = np.zeros(256, np.int64)
    for r in seen.filter("kind = 1").collect():
        byte_counts[r["item"]] = r["n"]
    ends = seen.filter("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n, v = words + ends, distinct + (1 if ends else 0)
    least = max(2.0, words / COMMON)
    top = vocabulary.filter(F.col("count") >= least).toArrow()
    order = np.argsort(top.column("word").to_numpy().view(np.uint64))
    common = spark.sparkContext.broadcast((top.column("word").to_numpy().view(np.uint64)[order], top.column("count").to_numpy()[order]))
    classes, share = symbols(byte_counts)
    symbol = spark.sparkContext.broadcast((classes, share))
    end = float(np.log10(ends + 1))
    kind = dict(docs.dtypes)["doc_id"]
    cut = pieces(rows)
    wanted = asked(cut, classes)
    counts_of = keep(wanted.groupBy("code").agg(F.sum("n").alias("n")), "tree-counts")
    values = wanted.select("piece", "code").join(grow(counts_of), "code").select("piece", "code", "value")
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, sums double, known long, score double, other array<long>"

    def work(table, lookup):
        names, counts = common.value
        classes, share = symbol.value
        codes, first = np.unique(lookup.column("code").to_numpy(), return_index=True)
        value = lookup.column("value").to_numpy()[first].astype(np.float64)
        out = []
        for batch in table.combine_chunks().to_batches():
            for part, texts in rounds(batch, "text"):
                words = Words(texts, lower=True)
                hashes, doc = words.hashes(), words.doc()
                hit, at = known(names, hashes)
                rows = part.num_rows
                sums = np.bincount(doc[hit], np.log10(counts[at[hit]] + 1.0), minlength=rows)
                found = np.bincount(doc[hit], minlength=rows)
                offsets = np.append(0, np.cumsum(np.bincount(doc[~hit], minlength=rows))).astype(np.int32)
                data, heads = stream(texts, words)
                code, ok = places(data, heads, classes)
                own = np.zeros(len(data))
                own[DEPTH:][ok] = value[np.searchsorted(codes, code[ok])] + share[data[DEPTH:][ok]]
                out.append(
                    pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id"),
                            part.column("held_out"),
                            pa.array(np.diff(words.first).astype(np.int64) + 1),
                            pa.array(sums + end),
                            pa.array(found.astype(np.int64) + (1 if ends else 0)),
                            pa.array(np.add.reduceat(own, heads[:-1])),
                            pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(hashes[~hit]))),
                        ],
                        names=["doc_id", "held_out", "n_tokens", "sums", "known", "score", "other"],
                    )
                )
        return pa.Table.from_batches(out)

    scored = cut.groupBy("piece").cogroup(values.groupBy("piece")).applyInArrow(work, schema)
    scored = keep(scored.withColumn("row", F.monotonically_increasing_id()), "scored-rows")
    drop(wanted)
    drop(counts_of)
    rare = scored.select("row", F.explode("other").alias("word"))
    rest = vocabulary.filter(F.col("count") < least)
    asks = rare.groupBy("word").agg(F.count("*").alias("asked"))
    often = max(2.0, (asks.agg(F.sum("asked")).first()[0] or 0) / COMMON)
    hot = asks.filter(F.col("asked") >= often).join(rest, "word", "left").select("word", F.coalesce("count", F.lit(0).cast("long")).alias("hot"))
    seen_hot = rare.join(F.broadcast(hot), "word", "left")
    cold = seen_hot.filter("hot is null").select("row", "word").join(rest, "word").select("row", "count")
    more = seen_hot.filter("hot > 0").select("row", F.col("hot").alias("count")).unionByName(cold)
    more = more.groupBy("row").agg(F.sum(F.log10(F.col("count") + 1.0)).alias("more"), F.count("*").alias("more_known"))
    return scored.drop("other").join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0).cast("long"))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("sums") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        "score",
    )
