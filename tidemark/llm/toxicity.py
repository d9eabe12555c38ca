"""Toxicity by a counterfactually regularised classifier over words and their beginnings.

A logistic model scores the features a text has: its words (runs of letters, lower-cased) and the beginnings of 4 to 8
bytes of the longer ones, which carry over to inflected forms; three words that begin alike are a feature more. It is fitted on labelled texts. Sentences of these that
name a group of people are copied with the name replaced by that of another group of the same kind (``GROUPS``), and the fit
adds ``PENALTY`` times the mean squared change of the logit between a sentence and its copy. A group's name that stands
in many toxic texts can then not carry weight of its own, and a neutral mention of the group keeps a low score.

The fit works on a bounded sample: at most about ``SAMPLE`` labelled texts by a hash of doc_id, of which the ``FEATURES``
features with the largest likelihood ratio are kept, and the ``PAIRS`` most frequent changes of features. Counts of features, ratios
and pairs are Spark aggregates; the rows of kept feature numbers are solved on the driver by proximal gradient steps (sizes bounded
by the parameters). Scoring reads every text once, in Arrow batches, and moves nothing.

Cases: a null or empty text, or one without letters, has no features and gets the score of the intercept; very long texts
are read whole, and a feature counts once however often it occurs, so length alone adds nothing. Labels: null ones are
left out; of repeated labels of a document the largest counts, of repeated doc_ids in the sample the text that sorts
first; labels of unknown documents and null doc_ids do no harm, and a null doc_id is never held out. Ties among features are
broken by their hash. Repeated rows are scored alike. Without labels every score is 0; with one class only, every score
is that class's share, smoothed. Extra columns do not matter, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.language import held_out
from tidemark.llm.text import Texts, Words, as_texts, mix, powers, rounds
from tidemark.scratch import keep

SAMPLE = 20_000
FEATURES = 4096
PAIRS = 4096
#: Texts of the sample that must have a feature, and least likelihood ratio (twice its log) of a kept one.
LEAST_TEXTS, LEAST_RATIO = 2, 8.0
PENALTY = 10.0
RIDGE, LASSO = 2e-6, 2e-6
STEPS = 500
THRESHOLD = 0.3
BEGINNINGS = (4, 5, 6, 7, 8)
#: So many distinct words of a text that begin alike are a feature of their own.
OFTEN = 3

# Names of groups of people that may stand for one another, by language and kind.
GROUPS = [
    ["women", "men"],
    ["woman", "man"],
    ["girls", "boys"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["gay", "lesbian", "straight", "bisexual", "transgender"],
    ["africans", "europeans", "asians", "americans", "mexicans", "arabs"],
    ["african", "european", "asian", "american", "mexican", "arab"],
    ["immigrants", "refugees", "natives"],
    ["frauen", "männer"],
    ["muslime", "christen", "juden"],
    ["femmes", "hommes"],
    ["musulmans", "chrétiens", "juifs"],
    ["mujeres", "hombres"],
    ["musulmanes", "cristianos", "judíos"],
]

_SENTENCE = regex.compile(r"[^.!?\n]+")
_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[:128] = 0x20
_LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTERS[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_random = np.random.default_rng(20240313)
_BYTE = _random.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word, of the beginnings of longer words, and of those that ``OFTEN`` words share; each once."""
    words = Words(Texts(_LETTERS[texts.data], texts.offsets))
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Each distinct word of a text once.
    doc, whole, at, lengths = words.doc(), words.hashes().view(np.int64), words.starts, words.ends - words.starts
    order = np.lexsort((whole, doc))
    order = order[_firsts(doc[order], whole[order])]
    doc, whole, at, lengths = doc[order], whole[order], at[order], lengths[order]
    docs, names = [doc], [whole]
    weights = powers(_STEP, max(BEGINNINGS))
    for n in BEGINNINGS:
        longer = np.flatnonzero(lengths > n)
        total = np.full(len(longer), n, np.uint64)
        for i in range(n):
            total += _BYTE[words.data[at[longer] + i]] * weights[i]
        own, name = doc[longer], mix(total).view(np.int64)
        order = np.lexsort((name, own))
        own, name = own[order], name[order]
        first = np.flatnonzero(_firsts(own, name))
        docs.append(own[first])
        names.append(name[first])
        often = first[np.diff(np.append(first, len(own))) >= OFTEN]
        docs.append(own[often])
        names.append(~name[often])
    return np.concatenate(docs), np.concatenate(names)


def _firsts(doc: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Of sorted pairs, which differ from the one before."""
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])
    return first


def distinct(doc: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs without repeats, in order."""
    order = np.lexsort((name, doc))
    doc, name = doc[order], name[order]
    first = _firsts(doc, name)
    return doc[first], name[first]


def lists(doc: np.ndarray, value: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """A list for each of n texts of pairs in order of the text."""
    ends = np.searchsorted(doc, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(value, kind))


def swapper(groups: list[list[str]]):
    """A function that gives (sentence, copy) for each sentence of a text that names a group."""
    follow = {name: own[(i + 1) % len(own)] for own in groups for i, name in enumerate(own)}
    if not follow:
        return lambda text: iter(())
    names = regex.compile(r"(?<!\p{L})(?:" + "|".join(sorted(map(regex.escape, follow), key=len, reverse=True)) + r")(?!\p{L})", regex.IGNORECASE)

    def swapped(text: str):
        if names.search(text):
            for m in _SENTENCE.finditer(text):
                if (copy := names.sub(lambda x: follow.get(x[0].lower(), x[0]), m[0])) != m[0]:
                    yield m[0], copy

    return swapped


def _texts_of(strings: list[str]) -> Texts:
    return as_texts(pa.array(strings, pa.large_string()))


def sampled(docs: DataFrame, labels: DataFrame, sample: int, buckets: int, bucket: int) -> DataFrame:
    """(doc_id, y, text) of at most about ``sample`` labelled documents outside the bucket."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(buckets, bucket))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("toxicity sample"), "doc_id"), 11).cast("double") / float(1 << 53)
    # The sample bounds what is sent to all tasks.
    known = known.filter(draw < min(1.0, sample / max(known.count(), 1)))
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    return texts.groupBy("doc_id").agg(F.max("y").alias("y"), F.min(F.coalesce("text", F.lit(""))).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = FEATURES, penalty: float = PENALTY, groups: list[list[str]] = GROUPS, buckets: int = 4, bucket: int = 2):
    """(intercept, hashes of features in order, their weights); None without labels."""
    seen = keep(sampled(docs, labels, sample, buckets, bucket), "toxicity-sample")
    counts = {r["y"]: r["n"] for r in seen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return None
    if len(counts) < 2:
        return logit((counts.get(1, 0) + 0.5) / (total + 1)), np.zeros(0, np.int64), np.zeros(0)

    def named(batches):
        for batch in batches:
            for part, texts in rounds(batch, "text"):
                doc, name = distinct(*features(texts))
                yield pa.RecordBatch.from_arrays([part.column("y"), lists(doc, name, len(texts), pa.int64())], names=["y", "names"])

    rows = keep(seen.mapInArrow(named, "y int, names array<bigint>"), "toxicity-features")
    n1, n = float(counts[1]), float(total)

    def entropy(a, b):
        return F.when(a > 0, a * F.log(a / b)).otherwise(0.0)

    each = rows.select("y", F.explode("names").alias("name")).groupBy("name").agg(F.sum("y").cast("double").alias("a"), F.count("*").cast("double").alias("m"))
    m, a = F.col("m"), F.col("a")
    ratio = 2 * (entropy(a, m * n1 / n) + entropy(m - a, m * (n - n1) / n) + entropy(n1 - a, (n - m) * n1 / n) + entropy(n - m - n1 + a, (n - m) * (n - n1) / n))
    best = each.filter(m >= LEAST_TEXTS).withColumn("ratio", ratio).filter(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "name").limit(most)
    chosen = np.sort(np.array([r["name"] for r in best.select("name").collect()], np.int64))
    shared = seen.sparkSession.sparkContext.broadcast(chosen)

    def numbered(batches):
        for batch in batches:
            names = batch.column("names")
            flat = names.flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(names)), np.diff(names.offsets.to_numpy()))
            doc, place = _placed(doc, flat, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("y"), lists(doc, place, len(names), pa.int32())], names=["y", "places"])

    def changed(batches):
        swapped = swapper(groups)
        for batch in batches:
            gone, come = [], []
            for text in batch.column("text").to_pylist():
                for pair in swapped(text):
                    doc, place = _placed(*features(_texts_of(list(pair))), shared.value)
                    before, after = set(place[doc == 0].tolist()), set(place[doc == 1].tolist())
                    if before != after:
                        gone.append(sorted(before - after))
                        come.append(sorted(after - before))
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.list_(pa.int32())), pa.array(come, pa.list_(pa.int32()))], names=["gone", "come"])

    table = rows.mapInArrow(numbered, "y int, places array<int>").toArrow()
    pairs = seen.select("text").mapInArrow(changed, "gone array<int>, come array<int>").groupBy("gone", "come").agg(F.count("*").alias("n"))
    pairs = pairs.orderBy(F.desc("n"), "gone", "come").limit(PAIRS).collect()
    return solve(table, pairs, chosen, penalty)


def _placed(doc: np.ndarray, name: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (text, feature) those with a chosen feature, and its number."""
    if not len(chosen):
        return doc[:0], np.zeros(0, np.int32)
    place = np.minimum(np.searchsorted(chosen, name), len(chosen) - 1)
    hit = chosen[place] == name
    return doc[hit], place[hit].astype(np.int32)


def logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def solve(table: pa.Table, pairs: list, chosen: np.ndarray, penalty: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Accelerated proximal gradient on the mean log loss, the weights' size and the mean squared change of paired logits."""
    y = table.column("y").to_numpy().astype(np.float64)
    places = table.column("places").combine_chunks()
    doc = np.repeat(np.arange(len(y)), np.diff(places.offsets.to_numpy()))
    col = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    k, n = len(chosen), len(y)
    signs = [(i, p, s, r["n"]) for i, r in enumerate(pairs) for s, side in ((-1.0, r["gone"]), (1.0, r["come"])) for p in side]
    pair, at, sign, often = (np.array(x) for x in zip(*signs, strict=True)) if signs else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    share = np.array([r["n"] for r in pairs], np.float64)
    share = penalty * share / max(share.sum(), 1)
    # A step for each feature by how much it can matter: its share of texts and of pairs.
    width = max(1.0, float(np.bincount(doc, minlength=n).max())) if len(doc) else 1.0
    size = 0.25 * width * np.bincount(col, minlength=k) / n + RIDGE
    if len(pair):
        wide = np.bincount(pair, minlength=len(pairs)).astype(np.float64)
        size += np.bincount(at, (share * wide)[pair], minlength=k)
    w, b = np.zeros(k), logit((y.sum() + 0.5) / (n + 1))
    at_w, at_b, turn = w.copy(), b, 1.0
    for _ in range(STEPS):
        z = at_b + (np.bincount(doc, at_w[col], minlength=n) if len(doc) else 0.0)
        off = (sigmoid(z) - y) / n
        slope = np.bincount(col, off[doc], minlength=k) + RIDGE * at_w if len(doc) else RIDGE * at_w
        if len(pair):
            move = np.bincount(pair, sign * at_w[at], minlength=len(pairs)) * share
            slope = slope + np.bincount(at, sign * move[pair], minlength=k)
        step = at_w - slope / size
        new = np.sign(step) * np.maximum(np.abs(step) - LASSO / size, 0.0)
        new_b = at_b - off.sum() / 0.25 / width
        after = (1 + np.sqrt(1 + 4 * turn * turn)) / 2
        at_w, at_b = new + (turn - 1) / after * (new - w), new_b + (turn - 1) / after * (new_b - b)
        w, b, turn = new, new_b, after
    return float(b), chosen[w != 0], w[w != 0]


def predict(df: DataFrame, model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with score and predicted (columns of these names are replaced)."""
    from pyspark.sql import types as T

    kept = df.drop("score", "predicted")
    extra = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            for part, texts in rounds(batch, text):
                score = np.zeros(len(texts))
                if shared.value is not None:
                    start, chosen, weights = shared.value
                    doc, place = _placed(*features(texts), chosen)
                    score = sigmoid(start + np.bincount(doc, weights[place], minlength=len(texts)))
                new = [pa.array(score), pa.array((score >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, "score", "predicted"])

    return kept.mapInArrow(work, T.StructType([*kept.schema.fields, *extra]))


def classify(docs: DataFrame, labels: DataFrame, buckets: int = 4, bucket: int = 2) -> DataFrame:
    """Learn from labels outside ``bucket`` of ``buckets``: doc_id, held_out, score and predicted of every row."""
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), buckets=buckets, bucket=bucket)
    rows = docs.select("doc_id", held_out(buckets, bucket).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "score", "predicted")
