"""Language ID by compression: the dictionary that shortens a text most names its language.

For each label raw-content zstandard dictionaries are cut from a bounded sample of labelled training
texts. A text is lower-cased, everything but letters becomes a space, and it is encoded block by block
with all ``SHARDS`` dictionaries of each label; the smallest total wins. The score is the share of bytes
that the best label saves over the second best. A margin of at most ``MIN_MARGIN`` is narrow and marks a
text as rejected, whatever its length; the query still reports the best label.

Bounds of the fit (the only thing that is sampled): about ``SAMPLE_TEXTS`` texts for each label, drawn by a
hash of doc_id. These are cut, whole, into pieces of ``PIECE_BYTES``; of the pieces of a dictionary each text's
first by a hash of the piece are taken, then each text's second, until ``DICTIONARY_BYTES`` are full.
All dictionaries together hold at most ``TOTAL_BYTES``: with very many labels each gets an equal share of that.
A task keeps no more pieces than fit its dictionaries, so neither long texts nor repeated rows gather anywhere.

Cases: null text or text without a letter gives ``und`` with score 0 and counts as rejected; very long texts
are encoded whole, a block at a time; ties go to the label with more training rows, then to the one that
sorts first; repeated rows are predicted alike; a table without labelled training rows predicts ``und``
everywhere; an empty table gives an empty result. A null doc_id is never held out. Of the caller's columns
lang_pred, score and rejected are replaced.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_TEXTS = 640
SHARDS = 2
PIECE_BYTES = 192
DICTIONARY_BYTES = 64 << 10
TOTAL_BYTES = 64 << 20
BLOCK_BYTES = 1 << 10
LEVEL = 6
MIN_MARGIN = 0.02
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"\P{L}+")


def plain(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).strip().encode()


def held_out(buckets: int, bucket: int):
    """Whether crc32 of doc_id as text falls in ``bucket``."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(crc % buckets == bucket, F.lit(False))


def best(pieces: set[tuple[int, int, bytes]], most: int) -> list[tuple[int, int, bytes]]:
    """The first pieces in order that fill ``most`` bytes."""
    out, size = [], 0
    for piece in sorted(pieces):
        if size >= most:
            break
        out.append(piece)
        size += len(piece[2]) + 1
    return out


def cut(text: str) -> list[tuple[int, int, bytes]]:
    """Pieces of a whole text with their order in it: by a hash, so that every place of the text may come first."""
    data = plain(text)
    pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
    order = sorted({(zlib.crc32(p), p) for p in pieces})
    return [(rank, crc, p) for rank, (crc, p) in enumerate(order)]


def fit(docs: DataFrame, train: str = "_train", label: str = "lang", text: str = "text") -> list[tuple[str, list[bytes]]]:
    """Labels and their dictionaries, most frequent first, from a sample of the rows in which ``train`` holds."""
    rows = docs.filter(F.col(train) & F.col(label).isNotNull() & F.col(text).isNotNull())
    counts = rows.groupBy(label).count().collect()
    if not counts:
        return []
    room = max(8, min(DICTIONARY_BYTES, TOTAL_BYTES // (SHARDS * len(counts))))
    numbers = docs.sparkSession.createDataFrame([(r[label], float(min(1.0, SAMPLE_TEXTS / r["count"]))) for r in counts], "_label string, _share double")
    order = F.xxhash64(F.col("doc_id"), F.lit("language sample"))
    draw = F.shiftrightunsigned(order, 11).cast("double") / float(1 << 53)
    # One row for each label, so the side that is sent to all tasks is small.
    drawn = rows.join(F.broadcast(numbers), F.col(label).cast("string") == F.col("_label")).filter(draw < F.col("_share"))
    drawn = drawn.select(F.col("_label"), F.pmod(order, F.lit(SHARDS)).cast("int").alias("_shard"), F.col(text).alias("_text"))

    def pick(batches):
        held = defaultdict(set)
        for batch in batches:
            for name, shard, whole in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held[name, shard] = set(best(held[name, shard] | set(best(set(cut(whole)), room)), room))
        rows = [(name, shard, *p) for (name, shard), own in held.items() for p in own]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _PIECE.types, strict=True)], schema=_PIECE)

    def join(table: pa.Table) -> pa.Table:
        own = best(set(zip(*(table.column(c).to_pylist() for c in ("rank", "crc", "piece")), strict=True)), room)
        content = b" ".join(p for _, _, p in own)[:room]
        return pa.table({"label": table.column("label")[:1], "shard": table.column("shard")[:1], "content": pa.array([content], pa.binary())})

    picked = drawn.mapInArrow(pick, "label string, shard int, rank long, crc long, piece binary")
    found = picked.groupBy("label", "shard").applyInArrow(join, "label string, shard int, content binary").collect()
    shards = defaultdict(list)
    for r in sorted(found, key=lambda r: r["shard"]):
        if len(r["content"]) >= 8:
            shards[r["label"]].append(bytes(r["content"]))
    return [(r[label], shards[str(r[label])]) for r in sorted(counts, key=lambda r: (-r["count"], r[label])) if shards[str(r[label])]]


_PIECE = pa.schema([("label", pa.string()), ("shard", pa.int32()), ("rank", pa.int64()), ("crc", pa.int64()), ("piece", pa.binary())])


class Predictor:
    def __init__(self, dictionaries: list[tuple[str, list[bytes]]]):
        import zstandard as zstd

        def encoder(content: bytes):
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            return zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        # A label with few texts lacks some shards; its first ones stand in, so that sums compare.
        self.labels = [name for name, _ in dictionaries]
        self.encoders = [[encoder(c) for c in (shards * SHARDS)[:SHARDS]] for _, shards in dictionaries]

    def __call__(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.labels or not _LETTER.search(text):
            return UNKNOWN, 0.0
        data = plain(text)
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        sizes = [sum(len(f(b)) for f in own for b in blocks) for own in self.encoders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.labels[0], 1.0
        second = min(s for i, s in enumerate(sizes) if i != best)
        return self.labels[best], (second - sizes[best]) / second


def predict(df: DataFrame, dictionaries: list[tuple[str, list[bytes]]], text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """``df`` with lang_pred, score and rejected (columns of these names are replaced)."""
    from pyspark.sql import types as T

    kept = df.drop("lang_pred", "score", "rejected")
    extra = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    shared = df.sparkSession.sparkContext.broadcast(dictionaries)

    def work(batches):
        predictor = Predictor(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            found = [predictor(t.as_py()) for t in texts]
            names, scores = [x[0] for x in found], [x[1] for x in found]
            out = [n == UNKNOWN or s <= min_margin for n, s in found]
            new = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    return kept.mapInArrow(work, T.StructType([*kept.schema.fields, *extra]))


def identify(docs: DataFrame, buckets: int = 4, bucket: int = 2) -> DataFrame:
    """Fit on the rows outside ``bucket`` of ``buckets`` and predict every row."""
    marked = docs.withColumn("held_out", held_out(buckets, bucket))
    dictionaries = fit(marked.select("doc_id", "lang", "text", (~F.col("held_out")).alias("_train")))
    return predict(marked.select("doc_id", "held_out", "text"), dictionaries).select("doc_id", "held_out", "lang_pred", "score", "rejected")
