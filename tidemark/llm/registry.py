"""Queries of the subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from tidemark.llm import oracles

#: Vocabulary of op2; a deployment may name another file.
VOCABULARY = "byte_bpe_50k.json"


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary_text(name: str = VOCABULARY) -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def bpe(spark, sf_dir):
    from tidemark.llm.bpe import digest

    return digest(_documents(spark, sf_dir), vocabulary_text())


def language(spark, sf_dir):
    from tidemark.llm.language import identify

    return identify(_documents(spark, sf_dir))


def substrings(spark, sf_dir):
    from tidemark.llm.substrings import report

    return report(_documents(spark, sf_dir))


def secrets(spark, sf_dir):
    from tidemark.llm.secrets import report

    return report(_documents(spark, sf_dir))


def jaccard(spark, sf_dir):
    from tidemark.llm.jaccard import join

    return join(_documents(spark, sf_dir))


def neardup(spark, sf_dir):
    from tidemark.llm.neardup import classes

    return classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def nearest(spark, sf_dir):
    from tidemark.llm.nearest import search

    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def suffixtree(spark, sf_dir):
    from tidemark.llm.suffixtree import score

    return score(_documents(spark, sf_dir))


def mixing(spark, sf_dir):
    from tidemark.llm.mixing import mix

    return mix(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def suffixes(spark, sf_dir):
    from tidemark.llm.suffixes import report

    return report(_documents(spark, sf_dir))


def trie(spark, sf_dir):
    from tidemark.llm.trie import conversations

    return conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def centroids(spark, sf_dir):
    from tidemark.llm.centroids import cluster

    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def toxicity(spark, sf_dir):
    from tidemark.llm.toxicity import classify

    return classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "op1_mixing": mixing,
        "op2_bpe": bpe,
        "op3_language": language,
        "op4_jaccard": jaccard,
        "op5_substrings": substrings,
        "op6_neardup": neardup,
        "op7_nearest": nearest,
        "op8_suffixtree": suffixtree,
        "op9_secrets": secrets,
        "op10_suffixes": suffixes,
        "op11_trie": trie,
        "op12_centroids": centroids,
        "op13_toxicity": toxicity,
        "pipeline": pipeline,
    }


def oracle_sql():
    return {
        "op4_jaccard": oracles.JACCARD,
        "op5_substrings": oracles.SUBSTRINGS,
        "op6_neardup": oracles.NEARDUP,
        "op9_secrets": oracles.SECRETS,
        "op10_suffixes": oracles.SUFFIXES,
        "op11_trie": oracles.TRIE,
        "op12_centroids": oracles.CENTROIDS,
    }
