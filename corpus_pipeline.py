"""A corpus pipeline over ``documents``: five stages, each one operator, each written and read again.

Cases, for every stage: null columns, empty and very long texts, repeated rows and columns of any further name pass through as the
stage says below; an empty table gives an empty one. The operators' modules say how ties go.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, jaccard, language, mixing, registry, secrets
from tidemark.scratch import keep

#: Near duplicates here: five words, similarity 0.8 or more.
NEAR = jaccard.Rule(words=5, percent=80)

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; a missing label is filled in.

    Null texts, texts without a letter and those whose two best languages are within the margin go. Repeated rows go or stay
    together; without labelled documents none is told, and all go.
    """
    marked = docs.withColumn("_train", ~language.held_out(4, 2))
    dictionaries = language.fit(marked)
    known = language.predict(marked, dictionaries).filter(~F.col("rejected"))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id (a null comes last).

    Null texts and texts without words resemble nothing and stay; of equal rows one stays.
    """
    return jaccard.representatives(docs, NEAR)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by a mark, and ``n_chars`` counted anew; a null text stays null, every row stays."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixing rates say: a document may come out several times or not at all.

    Equal rows with one doc_id are drawn alike; null and empty texts have no tokens and are drawn by the rate of the prior;
    labels of documents that are gone do no harm.
    """
    return mixing.drawn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of each document, as digests; a null text counts as an empty one, every row stays."""
    docs = docs.toDF(*[c if c in COLUMNS else f"__extra_{i}" for i, c in enumerate(docs.columns)])
    return bpe.digest(docs, registry.vocabulary_text(), ["doc_id", "lang", "source"])


def apart(stage):
    """The stage, with columns beside those of ``documents`` under names that cannot clash."""

    @functools.wraps(stage)
    def of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in COLUMNS else f"__extra_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).toDF(*docs.columns)

    return of


STAGES = [
    ("language ID", apart(language_id)),
    ("n-gram Jaccard join", apart(near_duplicates)),
    ("secret scans", apart(secret_scans)),
    ("mixing sources to target weights", apart(mixing_to_targets)),
    ("BPE encoding and decoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
