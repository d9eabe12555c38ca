"""Byte-level BPE encoding and decoding by batched merge rounds.

The symbols of many words lie in one flat array. A round looks up every adjacent pair by binary
search in the sorted pair keys of the vocabulary, takes the lowest rank of each word, merges all
places of that pair from the left, and drops the words that have no pair left. Words repeat, so each
worker keeps the ids of those it has seen, up to ``CACHE_WORDS``.

Cases: a null or empty text has no ids and decodes to an empty text. Rows are independent: repeated
rows and extra columns pass through, an empty table gives an empty table. Strings of the special
tokens in a text become the special ids, as the public library does by default. Of equal lowest ranks the leftmost pair
merges first. Very long texts are encoded whole, in rounds of array work; a single word of a megabyte needs a round over its
symbols for each rank that occurs in it.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Splitting pattern of byte-level vocabularies (a fixed value); white space is the Unicode property.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Words of which a worker keeps the ids; it starts anew beyond that.
CACHE_WORDS = 300_000
_NEVER = np.int64(1 << 40)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, content: str):
        model = json.loads(content)
        letters = byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        ids: dict[str, int] = model["model"]["vocab"]
        self.specials = {x["content"]: x["id"] for x in model["added_tokens"]}
        self.byte_id = np.array([ids[letters[b]] for b in range(256)], dtype=np.int64)
        size = 1 + max([*ids.values(), *self.specials.values()])
        self.size = np.int64(size)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        keys = np.array([ids[a] * size + ids[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], dtype=np.int64)[order]
        text = {i: bytes(byte_of[c] for c in s) for s, i in ids.items()}
        text |= {i: s.encode() for s, i in self.specials.items()}
        #: Bytes of each id; the last entry stands for a missing id.
        self.bytes = [text.get(i, b"") for i in range(size + 1)]
        self.split = regex.compile(PATTERN).findall
        marks = "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))
        self.mark = regex.compile(f"({marks})") if marks else None

    def words(self, text: str) -> list[str]:
        """Pieces of a text in order; a special token is a piece of its own."""
        if self.mark is None or not any(s in text for s in self.specials):
            return self.split(text)
        out: list[str] = []
        for i, part in enumerate(self.mark.split(text)):
            out.extend([f"\0special{part}"] if i % 2 else self.split(part))
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_owner = [], []
        while len(symbols):
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank = np.where(hit, self.ranks[at], _NEVER)
            rank = np.append(rank, _NEVER)
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, heads)
            best = np.repeat(best, np.diff(np.append(heads, len(symbols))))
            live = best < _NEVER
            if not live.all():
                done_symbols.append(symbols[~live])
                done_owner.append(owner[~live])
            chosen = live & (rank == best)
            # In a run of equal letters the same pair is chosen at neighbouring places: take every second.
            places = np.flatnonzero(chosen)
            if len(places):
                fresh = np.append(True, np.diff(places) > 1)
                run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                places = places[(np.arange(len(places)) - run) % 2 == 0]
                symbols = symbols.copy()
                symbols[places] = self.merged[at[places]]
                live[places + 1] = False
            symbols, owner = symbols[live], owner[live]
        if not done_symbols:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(words))


@functools.lru_cache(maxsize=4)
def vocabulary(content: str) -> Vocabulary:
    return Vocabulary(content)


class Encoder:
    """Encodes lists of texts and remembers words."""

    def __init__(self, vocab: Vocabulary, most: int = CACHE_WORDS):
        self.vocab, self.most = vocab, most
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int64)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.slot]
        if not new:
            return
        ordinary = [w for w in new if not w.startswith("\0special")]
        special = [w for w in new if w.startswith("\0special")]
        # A piece that merely looks like a mark cannot be: NUL never starts a piece with letters after it.
        ids, counts = self.vocab.encode_words([w.encode() for w in ordinary])
        ids = np.concatenate([ids, [self.vocab.specials[w[8:]] for w in special]]).astype(np.int32)
        counts = np.concatenate([counts, np.ones(len(special), np.int64)])
        at = len(self.slot)
        self.slot.update((w, at + i) for i, w in enumerate([*ordinary, *special]))
        self.ids = np.concatenate([self.ids, ids])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and offsets with one entry more than texts."""
        if len(self.slot) > self.most:
            self.forget()
        pieces = [self.vocab.words(t) for t in texts]
        flat = [w for p in pieces for w in p]
        self.learn(set(flat))
        slots = np.fromiter(map(self.slot.__getitem__, flat), dtype=np.int64, count=len(flat))
        start, count = self.start[slots], self.start[slots + 1] - self.start[slots]
        ends = np.concatenate([[0], np.cumsum(count)])
        index = np.arange(ends[-1]) + np.repeat(start - ends[:-1], count)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        return self.ids[index], ends[bounds]


def decode_ids(vocab: Vocabulary, ids: list[int]) -> str:
    return b"".join(map(vocab.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _groups(sizes: list[int], most: int):
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def encode(df: DataFrame, content: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of each text as array<int>; ``content`` is the vocabulary file's text.

    A column named ``out`` is replaced.
    """
    kept = df.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False))])
    shared = df.sparkSession.sparkContext.broadcast(content)

    def work(batches):
        encoder = Encoder(vocabulary(shared.value))
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            for a, b in _groups([len(x) for x in texts], 1 << 20):
                part = batch.slice(a, b - a)
                ids, offsets = encoder.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, out])

    return kept.mapInArrow(work, schema)


def decode(df: DataFrame, content: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of each id array, special tokens included; a null array gives an empty text."""
    kept = df.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())])
    shared = df.sparkSession.sparkContext.broadcast(content)

    def work(batches):
        vocab = vocabulary(shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            lengths = [n or 0 for n in column.value_lengths().to_pylist()]
            for a, b in _groups(lengths, 1 << 19):
                part = batch.slice(a, b - a)
                flat = column.slice(a, b - a).flatten().fill_null(int(vocab.size)).to_numpy(zero_copy_only=False).tolist()
                ends = np.cumsum([0, *lengths[a:b]]).tolist()
                texts = [decode_ids(vocab, flat[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
                done = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, done], names=[*part.schema.names, out])

    return kept.mapInArrow(work, schema)


def digest(docs: DataFrame, content: str, carried: list[str] | None = None) -> DataFrame:
    """Per document the carried columns, the number of ids and digests of the ids and of the decoded text."""
    carried = carried or ["doc_id"]
    coded = encode(docs.select(*carried, "text"), content).select(*carried, "ids")
    back = decode(coded, content)
    return back.select(
        *carried,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
