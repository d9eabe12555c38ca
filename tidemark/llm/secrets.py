"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds are judged each by itself. Weak candidates (40-character keys without a name beside them,
and endpoints) mean little alone: they are reported only when the parts that complete them occur
within ``SCOPE`` characters: a bare key needs an access identifier or an endpoint that carries one
beside it, an endpoint needs an access identifier or an assigned secret.

Positions come without user code: a regular expression splits the text into what lies between its
matches, and the running sum of the lengths of gaps and matches gives the starts. The interval join of
the parts is a sweep over the intervals of one text in order of their starts: a pass forward carries
the end of the last access identifier and of the last secret, a pass over the mirrored intervals
carries the nearest later ones. A text's intervals never leave its row, so nothing is shuffled, no
pair is made and a hot source costs what its bytes cost.

Time is linear in the text and its matches, whatever the text: no pattern repeats a group or starts anew
inside a run that it has read, sweeps append to lists of ``RUN`` entries, and redaction cuts pieces of
``PIECE`` characters out of which a span's surroundings are taken.

Cases: null and empty texts have no spans. Very long texts are scanned whole; one takes some ten times its size
in memory. Repeated rows are scanned alike. ``scan`` replaces columns named base and weak; ``redact``
and ``report`` leave all other columns as they are, whatever their names. An empty table gives an empty result.
Of spans with equal starts the kind listed first comes first, then the shorter; a redaction replaces
what overlapping spans cover once. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE = 400
#: Base kinds in the order in which spans of one start are listed, then the weak kinds.
KINDS = ["assign", "access", "hex", "key", "endpoint"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KEY = r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])"
URL = r"https?://[A-Za-z0-9.-]++(?::[0-9]++)?"
#: A host is a whole run of its characters, and no part of a path.
HOST = r"(?<![A-Za-z0-9./-])[A-Za-z0-9.-]++(?<=\.amazonaws\.com[.-]?)"
RUN = 256
PIECE = 1024
_SPANS = "array<struct<start:int,kind:int,stop:int>>"
_FAR = 1 << 30


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def swept(rows: Column, start: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], kind: str) -> Column:
    """``out(state, row)`` of each row, an array of ``kind``; ``step(state, row)`` is the state of the next row.

    Appending to an array copies it, so rows are taken in runs: a run's array is short, and so is that of runs.
    """
    none = F.array().cast(kind)

    def of_run(before: Column, run: Column) -> Column:
        return F.aggregate(
            run,
            F.struct(before.alias("state"), none.alias("out")),
            lambda own, row: F.struct(
                step(own["state"], row).alias("state"),
                F.concat(own["out"], F.array(out(own["state"], row))).alias("out"),
            ),
        )

    def of_all(rows: Column) -> Column:
        count = F.floor((F.size(rows) - 1) / RUN).cast("int")
        done = F.aggregate(
            F.transform(F.sequence(F.lit(0), count), lambda i: F.slice(rows, i * RUN + 1, RUN)),
            F.array(F.struct(start.alias("state"), none.alias("out"))),
            lambda whole, run: F.concat(whole, F.array(of_run(F.element_at(whole, -1)["state"], run))),
        )
        return F.when(F.size(rows) > 0, F.flatten(F.transform(done, lambda x: x["out"]))).otherwise(none)

    return bound(rows, of_all)


def _spans(text: Column, pattern: str, kind: int, value: int = 0) -> Column:
    """Spans of all matches; if a group ``value`` is named, of those whose group has 12 characters."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(
        F.transform(gaps, lambda x: F.char_length(x)),
        F.transform(found, lambda x: F.char_length(x)),
        lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")),
    )

    def span(at: Column, x: Column) -> Column:
        return F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + x["match"]).alias("stop"))

    # The last gap has no match after it: its length is null there and it adds no span.
    inner = F.filter(lengths, lambda x: x["match"].isNotNull())
    walked = swept(inner, F.lit(0), lambda at, x: at + x["gap"] + x["match"], span, _SPANS)
    if value:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
        pairs = F.arrays_zip(walked.alias("span"), values.alias("value"))
        walked = F.transform(F.filter(pairs, lambda x: F.char_length(x["value"]) >= 12), lambda x: x["span"])
    return F.when(F.regexp_like(text, F.lit(pattern)), walked).otherwise(F.array()).cast(_SPANS)


def _sweep(spans: Column, mirrored: bool) -> Column:
    """Each span with the distance to the nearest access identifier, secret and endpoint on one side.

    The mirrored pass walks the spans backwards; distances are then to what follows.
    """
    kinds = {"access": 1, "secret": 0, "endpoint": 4}

    def gap(edge: Column, x: Column) -> Column:
        return F.greatest(edge - x["stop"], F.lit(0)) if mirrored else F.greatest(x["start"] - edge, F.lit(0))

    def nearer(edge: Column, x: Column, holds: Column) -> Column:
        return F.when(holds, F.least(edge, x["start"]) if mirrored else F.greatest(edge, x["stop"])).otherwise(edge)

    return swept(
        F.reverse(spans) if mirrored else spans,
        F.struct(*[F.lit(_FAR if mirrored else -_FAR).alias(name) for name in kinds]),
        lambda state, x: F.struct(*[nearer(state[name], x, x["kind"] == k).alias(name) for name, k in kinds.items()]),
        lambda state, x: F.struct(*[x[c].alias(c) for c in ("start", "kind", "stop")], *[gap(state[name], x).alias(name) for name in kinds]),
        "array<struct<start:int,kind:int,stop:int,access:int,secret:int,endpoint:int>>",
    )


def _near(parts: Column, scope: int) -> Column:
    """Each span with whether an access identifier, a secret and an endpoint lie within ``scope`` characters."""
    before, after = _sweep(parts, False), F.reverse(_sweep(parts, True))
    return F.zip_with(
        before,
        after,
        lambda a, b: F.struct(
            a["start"].alias("start"),
            a["kind"].alias("kind"),
            a["stop"].alias("stop"),
            (F.least(a["access"], b["access"]) <= scope).alias("access"),
            (F.least(a["secret"], b["secret"]) <= scope).alias("secret"),
            (F.least(a["endpoint"], b["endpoint"]) <= scope).alias("endpoint"),
        ),
    )


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"))).cast(_SPANS)


def linked(df: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``df`` with those of its ``weak`` spans whose complement lies within ``scope`` characters.

    A second sweep, over keys and the endpoints that have an access identifier beside them, finds the keys
    that are linked through an endpoint.
    """
    none = F.array().cast(_SPANS)
    parts = F.when(F.size("weak") > 0, _near(F.array_sort(F.concat("base", "weak")), scope))
    first = df.withColumn("_near", parts)
    alone = F.filter("_near", lambda x: (x["kind"] == 3) & ~x["access"])
    carriers = F.filter("_near", lambda x: (x["kind"] == 4) & x["access"])
    direct = F.filter("_near", lambda x: ((x["kind"] == 3) & x["access"]) | ((x["kind"] == 4) & (x["access"] | x["secret"])))
    both = F.exists("_near", lambda x: (x["kind"] == 3) & ~x["access"]) & F.exists("_near", lambda x: (x["kind"] == 4) & x["access"])
    over = F.filter(_near(F.array_sort(_plain(F.concat(alone, carriers))), scope), lambda x: (x["kind"] == 3) & x["endpoint"])
    found = F.concat(_plain(direct), F.when(both, _plain(over)).otherwise(none))
    return first.withColumn("weak", F.when(F.size("weak") > 0, F.array_sort(found)).otherwise(none)).drop("_near")


def scan(df: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``df`` with ``base`` and ``weak``: arrays of (start, kind, stop), kind an index into KINDS."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base = df.withColumn(
        "base",
        F.array_sort(F.concat(_spans(whole, ASSIGN, 0, value=2), _spans(whole, ACCESS, 1), _spans(whole, HEX, 2))),
    )
    # A weak part needs an access identifier or an assigned secret in its text.
    able = F.exists("base", lambda x: x["kind"] < 2)
    weak = F.concat(_spans(whole, KEY, 3), _spans(whole, URL, 4), _spans(whole, HOST, 4))
    none = F.array().cast(_SPANS)
    with_weak = base.withColumn("weak", F.when(able, weak).otherwise(none))
    return linked(with_weak, scope)


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string")),
        ),
        ",",
    )


def report(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "weak"))).alias("spans"),
    )


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``df`` with every span of ``text`` replaced; overlapping spans count as one."""
    found = scan(df.select(F.struct("*").alias("row"), F.col(text).alias("whole")), "whole")
    spans = F.array_sort(F.concat("base", "weak"))
    # Each span with the end of what those before it cover: where it begins after that, a piece of text stays.
    behind = swept(
        spans,
        F.lit(0),
        lambda at, x: F.greatest(at, x["stop"]),
        lambda at, x: F.struct(at.alias("at"), x["start"].alias("start"), x["stop"].alias("stop")),
        "array<struct<at:int,start:int,stop:int>>",
    )
    found = found.withColumn("behind", behind).withColumn("pieces", F.regexp_extract_all("whole", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))

    def between(start: Column, stop: Column) -> Column:
        first = F.floor(start / PIECE).cast("int")
        near = F.array_join(F.slice("pieces", first + 1, F.floor(stop / PIECE).cast("int") - first + 1), "")
        return F.substring(near, start - first * PIECE + 1, stop - start)

    parts = F.transform(F.filter("behind", lambda x: x["start"] >= x["at"]), lambda x: F.concat(between(x["at"], x["start"]), F.lit(mark)))
    last = F.array_max(F.transform("behind", lambda x: x["stop"]))
    cut = F.concat(F.array_join(parts, ""), between(last, F.char_length("whole")))
    clean = F.when(F.size("behind") > 0, cut).otherwise(F.col("whole"))
    return found.select(F.col("row").withField(f"`{text}`", clean).alias("row")).select("row.*")
