"""Toxicity: held-out accuracy, scores by a plain program, and neutral mentions of groups."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity
from tidemark.llm.text import as_texts

LABELS = "doc_id long, quality int, toxic int"
FILL = "river stone cloud garden window paper bridge summer table letter music forest winter coffee silver mountain".split()


def names_of(text):
    """Names of the features of a text, by one feature call for each."""
    words = set(re.findall(r"[a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))
    begins = {}
    for w in words:
        for n in toxicity.BEGINNINGS:
            if len(w.encode()) > n:
                begins.setdefault(w.encode()[:n], set()).add(w)
    return words, begins


def test_features_by_a_plain_program():
    import pyarrow as pa

    texts = ["Stones stone stoned stonedly, STONER! x", "", None, "déjà-vu 漢字漢字漢 a1b", "a " * 5000]
    doc, name = toxicity.features(as_texts(pa.array(texts, pa.large_string())))
    for i, t in enumerate(texts):
        words, begins = names_of(t or "")
        assert len(set(name[doc == i].tolist())) == (doc == i).sum() == len(words) + len(begins) + sum(len(w) >= toxicity.OFTEN for w in begins.values())
    one = toxicity.features(as_texts(pa.array(["stone"], pa.large_string())))[1]
    assert np.isin(one, name[doc == 0]).all()


def corpus(seed=0, n=900):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(FILL, k=30)
        toxic = rng.random() < 0.3
        if toxic:
            words[rng.randrange(30)] = rng.choice(["blorkhead", "blorkface", "snarfing"])
        # One group's name stands in most toxic texts and few others.
        if rng.random() < (0.8 if toxic else 0.05):
            words[rng.randrange(30)] = "muslims"
        rows.append((i, " ".join(words) + ".", "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_learns_and_leaves_neutral_mentions_alone(spark, docs_of):
    rows, labels = corpus()
    probes = [(-1 - i, f"the {g} walked by the river and the garden", None, None, 0) for i, g in enumerate(toxicity.GROUPS[3])]
    docs, known = docs_of(rows + probes), spark.createDataFrame(labels, LABELS)
    out = {r["doc_id"]: r for r in toxicity.classify(docs, known).collect()}
    truth = {d: t for d, _, t in labels}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert held and all(out[d]["held_out"] for d in held)
    assert np.mean([out[d]["predicted"] == truth[d] for d in held]) > 0.98
    assert all(out[-1 - i]["predicted"] == 0 for i in range(6))
    spread = lambda m: (lambda s: max(s) - min(s))([r["score"] for r in toxicity.predict(docs.filter("doc_id < 0"), m).collect()])
    assert spread(toxicity.fit(docs, known)) < 0.02 < spread(toxicity.fit(docs, known, penalty=0.0))


def test_score_is_the_sum_of_weights(spark, docs_of):
    import pyarrow as pa

    rows, labels = corpus(1, 300)
    model = toxicity.fit(docs_of(rows), spark.createDataFrame(labels, LABELS))
    weight = dict(zip(model[1].tolist(), model[2].tolist(), strict=True))
    for r in toxicity.predict(docs_of(rows), model).collect():
        own = toxicity.features(as_texts(pa.array([r["text"]], pa.large_string())))[1]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-model[0] - sum(weight.get(x, 0.0) for x in own.tolist()))))


def test_swaps():
    swapped = toxicity.swapper([["men", "women"], ["a", "b", "c"]])
    assert list(swapped("Men and womenfolk! Nobody here. b or WOMEN?")) == [("Men and womenfolk", "women and womenfolk"), (" b or WOMEN", " c or men")]
    assert list(toxicity.swapper([])("men")) == []


def test_labels_do_not_leak(spark, docs_of):
    """Labels of held-out rows, and lang or source of any, change no score."""
    rows, labels = corpus(2, 200)
    turned = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, q, t in labels]
    others = [(d, t, "xx", f"s{d}", 7) for d, t, *_ in rows]
    score = lambda r, m: [(x["doc_id"], round(x["score"], 9)) for x in toxicity.classify(docs_of(r), spark.createDataFrame(m, LABELS)).orderBy("doc_id").collect()]
    assert score(rows, labels) == score(others, turned)


def test_odd_rows(spark, docs_of, odd_texts):
    labels = [(3, 1, 1), (3, 1, 0), (9, None, None), (8, 0, 0), (77, 1, 1), (None, 1, 1), (11, 1, 0)]
    docs = docs_of(odd_texts, extra=True).select("*", *[F.lit(1).alias(c) for c in ("y", "names", "predicted", "toxic")])
    out = toxicity.classify(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == len(odd_texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (0, 1, 2)}) == 1
    none = toxicity.classify(docs, spark.createDataFrame([], LABELS)).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.classify(docs_of([]), spark.createDataFrame(labels, LABELS)).count() == 0
    single = toxicity.classify(docs, spark.createDataFrame([(8, 0, 0), (9, 0, 0)], LABELS)).collect()
    assert len({r["score"] for r in single}) == 1
