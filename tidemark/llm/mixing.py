"""Mixing documents to target weights of domains, with soft membership, in DataFrame functions only.

Domains come from a table of labels: toxic, low (neither toxic nor of quality) and good. A naive Bayes
classifier over words and marks of style gives each document a posterior over them. It is fitted on
at most ``SAMPLE`` labelled documents, chosen by a hash of doc_id, and keeps the ``FEATURES`` features with the
largest divergence between domains, so that its size is bounded; it predicts all documents.

Rates r >= 0 say how often a document is to be drawn. Expected tokens of domain d are
sum(r_i * n_i * p_id). Projected gradient steps minimise the squared distance of these totals to the targets,
measured by the inverse of the Gram matrix of the first totals, in which a step of 1 never overshoots:
r_i <- max(floor, r_i - p_i . W (T - t)). A step needs one aggregate of the size of a domain by domain
matrix over all documents; rates themselves are never moved, as each document folds the short list of
gradients into its own rate.

Cases: null and empty texts have no tokens, the prior as posterior, and a rate like any other. Labels
that are null in both columns, labels of unknown documents and repeated labels of one document (the first
by quality and toxic counts) do no harm. Without labels all posteriors are equal. Targets go by name, in any order; a domain without one
gets none, an unknown one is refused. Ties among features go by their hash. A domain that no text
has cannot reach its target; the nearest totals are fitted, and ``off_target`` says how far the farthest domain's
share of tokens stays from its target. Repeated rows get equal rates and equal draws. Very long texts are taken
whole; a task holds one's distinct words. Extra columns do not matter, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.scratch import keep

#: Target share of the tokens of each domain.
TARGETS = {"good": 0.85, "low": 0.10, "toxic": 0.05}
DOMAINS = list(TARGETS)
SAMPLE = 20_000
FEATURES = 384
SMOOTH = 2.0
#: Names under this number are marks of style.
STYLE = 100
STEPS = 60
CLOSE = 1e-4
#: A step that gains less than this share is slow, and so many slow ones in a row are the end.
SLOW, PATIENCE = 2e-3, 3
#: Share of the metric of all documents in that of the documents that are free to move.
DAMP = 0.05


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when(quality == 1, "good").when(toxic == 0, "good")


def with_features(df: DataFrame, text: Column, out: str) -> DataFrame:
    """``df`` with the distinct feature names of a text: its words by hash, and marks of style as small numbers.

    Each stage names what the next one uses several times, so that it is computed once.
    """
    columns = df.columns

    def share(chars: str) -> Column:
        return 1 - F.char_length(F.regexp_replace("_text", f"[{chars}]+", "")) / F.col("_size")

    def bin_of(name: str, base: int, steps: list[float]) -> Column:
        return sum(((F.col(name) >= x).cast("long") for x in steps), F.lit(base).cast("long"))

    df = df.withColumn("_text", text).withColumn("_size", F.greatest(F.char_length("_text"), F.lit(1)).cast("double"))
    df = df.withColumn("_words", F.split(F.lower("_text"), r"[^\p{L}\p{N}]+", -1))
    df = df.withColumns({"_many": F.size("_words"), "_hashes": F.array_distinct(F.transform("_words", lambda w: F.xxhash64(w)))})
    df = df.withColumns(
        {
            "_upper": share("A-Z"),
            "_marks": share("!#$%&*|{}<>"),
            "_digits": share("0-9"),
            "_kinds": F.size("_hashes") / F.greatest(F.col("_many"), F.lit(1)),
            "_log": F.log10("_size"),
        }
    )
    style = [
        bin_of("_upper", 0, [0.01, 0.03, 0.06, 0.1, 0.2, 0.4]),
        bin_of("_marks", 10, [0.001, 0.005, 0.02, 0.05, 0.1]),
        bin_of("_digits", 20, [0.001, 0.01, 0.05, 0.2]),
        bin_of("_log", 30, [1.3, 1.7, 2, 2.3, 2.7, 3, 3.3, 3.7, 4]),
        bin_of("_kinds", 40, [0.02, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]),
    ]
    return df.withColumn(out, F.concat("_hashes", F.array(*style))).select(*columns, out)


def tokens(text: Column) -> Column:
    """Number of words between ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[float], dict[int, list[float]]]:
    """Log prior of each domain and, for each kept feature, its log likelihood ratio in each domain."""
    known = labels.select("doc_id", domain(F.col("quality"), F.col("toxic")).alias("domain")).filter(F.col("domain").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    rows = known.count()
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("mixing sample"), "doc_id"), 11).cast("double") / float(1 << 53)
    # The sample bounds what is sent to all tasks; no text is shuffled to be found.
    known = F.broadcast(known.filter(draw < min(1.0, sample / max(rows, 1))))
    seen = known.join(docs.select("doc_id", "text").filter(F.col("text").isNotNull()), "doc_id")
    seen = keep(with_features(seen, F.col("text"), "names").select("domain", "names"), "mixing-sample")
    counts = {r["domain"]: r["n"] for r in seen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = [math.log((counts.get(d, 0) + 1) / (total + len(DOMAINS))) for d in DOMAINS]
    each = [F.sum((F.col("domain") == d).cast("long")).alias(d) for d in DOMAINS]
    names = keep(seen.select("domain", F.explode("names").alias("name")).groupBy("name").agg(*each), "mixing-features")
    # A mark of style is one of a few that every text has; a word is one of the distinct words of its domain.
    style = (F.col("name") >= 0) & (F.col("name") < STYLE)
    words = names.filter(~style).agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DOMAINS]).first()
    of = {d: F.when(style, F.lit(counts.get(d, 0))).otherwise(F.lit(words[d])) for d in DOMAINS}
    mean = (sum((F.col(d) for d in DOMAINS), F.lit(0)) + 0.5) / (sum(of.values(), F.lit(0)) + 1)
    weight = {d: F.log((F.col(d) + SMOOTH * mean) / (of[d] + SMOOTH) / mean) for d in DOMAINS}
    gain = sum((F.col(d) * weight[d] for d in DOMAINS), F.lit(0.0)) + F.when(style, float(1 << 40)).otherwise(0.0)
    best = names.filter(style | (sum((F.col(d) for d in DOMAINS), F.lit(0)) >= 3)).select("name", *[weight[d].alias(f"w_{d}") for d in DOMAINS], gain.alias("gain"))
    kept = best.orderBy(F.desc("gain"), "name").limit(FEATURES).collect()
    return prior, {r["name"]: [r[f"w_{d}"] for d in DOMAINS] for r in kept}


def _added(found: str, table: dict[int, float], start: float) -> Column:
    """``start`` and the weights of the features found."""
    if not table:
        return F.lit(start)
    weight = F.create_map(*[x for n, w in table.items() for x in (F.lit(n).cast("long"), F.lit(w))])
    return F.aggregate(found, F.lit(start), lambda total, n: total + F.element_at(weight, n))


def posteriors(docs: DataFrame, model: tuple[list[float], dict[int, list[float]]], text: str = "text") -> DataFrame:
    """``docs`` with n_tokens and p: an array of one probability for each domain."""
    prior, weights = model
    whole = F.coalesce(F.col(text), F.lit(""))
    out = with_features(docs.withColumn("n_tokens", tokens(whole)), whole, "_names")
    if weights:
        kept = F.array(*[F.lit(n).cast("long") for n in weights])
        found = F.array_intersect("_names", kept)
    else:
        found = F.array().cast("array<long>")
    sums = []
    for i, start in enumerate(prior):
        table = {n: float(w[i]) for n, w in weights.items()}
        sums.append(F.when(F.col("n_tokens") > 0, _added("_found", table, float(start))).otherwise(float(start)))
    out = out.withColumn("_found", found).drop("_names").withColumn("_sums", F.array(*sums)).drop("_found")
    top = F.array_max("_sums")
    odds = F.transform("_sums", lambda x: F.exp(x - top))
    out = out.withColumn("_odds", odds)
    whole_odds = F.aggregate("_odds", F.lit(0.0), lambda a, b: a + b)
    return out.withColumn("p", F.transform("_odds", lambda x: x / whole_odds)).drop("_sums", "_odds")


def solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Gaussian elimination with pivots; a direction without mass gets no step."""
    n = len(right)
    rows = [[*matrix[i], right[i]] for i in range(n)]
    scale = max(abs(x) for row in matrix for x in row) or 1.0
    for i in range(n):
        pivot = max(range(i, n), key=lambda j: abs(rows[j][i]))
        rows[i], rows[pivot] = rows[pivot], rows[i]
        if abs(rows[i][i]) < 1e-12 * scale:
            rows[i] = [0.0] * (n + 1)
            rows[i][i] = 1.0
            continue
        for j in range(i + 1, n):
            f = rows[j][i] / rows[i][i]
            rows[j] = [a - f * b for a, b in zip(rows[j], rows[i], strict=True)]
    out = [0.0] * n
    for i in reversed(range(n)):
        out[i] = (rows[i][n] - sum(rows[i][j] * out[j] for j in range(i + 1, n))) / rows[i][i]
    return out


def goals(targets: dict[str, float], domains: list[str]) -> list[float]:
    """The targets in the order of the domains, summing to one; a domain that is not named is to have no tokens."""
    if unknown := sorted(set(targets) - set(domains)):
        raise ValueError(f"no such domain: {', '.join(unknown)}; there are {', '.join(domains)}")
    if any(not 0 <= s < math.inf for s in targets.values()) or not (total := sum(targets.values())) > 0:
        raise ValueError("targets must be shares of at least 0, and one above")
    return [targets.get(name, 0.0) / total for name in domains]


def rates(members: DataFrame, targets: dict[str, float], floor: float = 0.0, scale: float = 1.0, domains: list[str] | None = None) -> DataFrame:
    """``members`` (n_tokens, p, ...) with rate and off_target; targets are shares of ``scale`` times all tokens.

    ``domains`` names the places of p (as the targets are ordered, if not given). off_target: the largest distance of a
    domain's expected share from its target, the same for all rows.
    """
    shares = goals(targets, domains or list(targets))
    d = range(len(shares))
    gram = [F.sum(F.col("n_tokens") * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}") for i in d for j in d]
    first = members.agg(F.sum("n_tokens").alias("n"), *gram).first()
    n = float(first["n"] or 0)
    if n == 0:
        return members.withColumns({"rate": F.lit(1.0), "off_target": F.lit(None).cast("double")})
    weight = [[(first[f"g{i}_{j}"] or 0.0) / n for j in d] for i in d]
    goal = [scale * s for s in shares]
    steps: list[list[float]] = []
    before, off_before, left, slow = math.inf, goal, math.inf, 0
    for turn in range(STEPS + 1):
        now = F.col("rate")
        free = (now > floor).cast("double")
        sums = [F.sum(now * F.col("n_tokens") * F.col("p")[i]).alias(f"t{i}") for i in d]
        gram = [F.sum(free * F.col("n_tokens") * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}") for i in d for j in d]
        got = members.select("n_tokens", "p", rate_from(steps, floor).alias("rate")).agg(*sums, *gram).first()
        off = [(got[f"t{i}"] or 0.0) / n - goal[i] for i in d]
        left = max(map(abs, off))
        if left <= CLOSE:
            break
        # The squared distance that the steps descend.
        size = math.sqrt(max(0.0, sum(a * b for a, b in zip(off, solve(weight, off), strict=True))))
        if size > before and steps:
            # Too far: take the step back and take the one that always descends.
            steps.pop()
            off, metric, left = off_before, weight, max(map(abs, off_before))
        else:
            # The metric of the documents that are free to move takes fewer steps.
            metric = [[(got[f"g{i}_{j}"] or 0.0) / n + DAMP * weight[i][j] for j in d] for i in d]
        step = solve(metric, off)
        slow = slow + 1 if 0 <= before - size < SLOW * size else 0
        if turn == STEPS or max(map(abs, step)) < 1e-6 or slow >= PATIENCE:
            break
        before, off_before = min(before, size), off
        steps.append(step)
    return members.withColumns({"rate": rate_from(steps, floor), "off_target": F.lit(left)})


def rate_from(steps: list[list[float]], floor: float) -> Column:
    """Rate of a document with posterior p after these gradient steps."""
    out = F.lit(1.0)
    for step in steps:
        move = sum((F.col("p")[i] * F.lit(float(v)) for i, v in enumerate(step)), F.lit(0.0))
        out = F.greatest(F.lit(floor), out - move)
    return out


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, floor: float = 0.0, scale: float = 1.0) -> DataFrame:
    """doc_id, n_tokens, the posterior of each domain, rate and off_target of each row."""
    goals(targets, DOMAINS)
    model = fit(docs, labels)
    members = keep(posteriors(docs.select("doc_id", "text"), model).drop("text"), "mixing-members")
    out = rates(members, targets, floor, scale, DOMAINS)
    return out.select("doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", "off_target")


def drawn(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, floor: float = 0.0, scale: float = 1.0, seed: str = "mix") -> DataFrame:
    """``docs``, each row as often as its rate says: the whole part, and once more with the chance of the rest.

    The chance is a hash of the text and doc_id, so a rerun draws alike.
    """
    goals(targets, DOMAINS)
    model = fit(docs, labels)
    # The caller's columns travel as one, so that no name of theirs meets one of ours.
    packed = docs.select(F.struct("*").alias("row"), F.col("text"))
    rows = keep(posteriors(packed, model).drop("text"), "mixing-members")
    with_rate = rates(rows, targets, floor, scale, DOMAINS)
    luck = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "row.doc_id", "row.text"), 11).cast("double") / float(1 << 53)
    times = F.floor(F.col("rate") + luck).cast("int")
    return with_rate.withColumn("_times", F.explode(F.array_repeat(F.lit(1), times))).select("row.*")
