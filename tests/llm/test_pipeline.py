"""The pipeline and the registry."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import registry, secrets


def words(rng, lang, n):
    parts = {"en": ["th", "er", "on", "an", "in", "at"], "de": ["sch", "ung", "ei", "en", "cht", "ber"]}[lang]
    return " ".join("".join(rng.choices(parts, k=rng.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('tables')}"
    rng = random.Random(1)
    rows = [(i, words(rng, lang := ["en", "de"][i % 2], 120), lang, f"src{i % 3}", 0) for i in range(120)]
    rows += [(200, rows[0][1], "en", "src0", 0), (201, rows[1][1] + " zz", None, "src0", 0), (202, None, "en", "s", 0), (203, "", None, None, None), (204, "!!! 123", "en", "s", 0)]
    rows += [(205, words(rng, "en", 80) + " password = hunter2hunter2 end", "en", "s", 0), (None, words(rng, "en", 90), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("score", F.lit("mine")).withColumn("k1", F.lit(1)).write.parquet(f"{root}/documents.parquet")
    labels = [(i, int(i % 5 != 0), int(i % 7 == 0)) for i in range(0, 120, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir).cache()
        seen.append(docs)
        assert i == 4 or docs.columns == columns
    told, first, clean, mixed, coded = seen
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    assert set(range(120)) <= ids(told) and not ids(told) & {202, 203, 204}
    assert told.filter("doc_id = 201").first()["lang"] == "de"
    assert ids(first) == ids(told) - {200, 201} and first.count() == len(ids(first))
    redacted = clean.filter("doc_id = 205").first()
    assert "hunter2" not in redacted["text"] and redacted["n_chars"] == len(redacted["text"])
    assert secrets.report(clean).filter("n_assign > 0").count() == 0
    assert ids(mixed) <= ids(clean) and {r["score"] for r in mixed.collect()} == {"mine"}
    assert coded.count() == mixed.count()


def test_run_and_empty(spark, sf_dir, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0) for t in ("documents", "labels"))
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []


def test_registry():
    import __spark_entry__ as entry

    names = [n.split("_")[0] for n in registry.queries()]
    assert names == [f"op{i}" for i in range(1, 14)] + ["pipeline"]
    assert set(registry.queries()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, name):
    root = "/root/testdata/sf0.001"
    df = registry.queries()[name](spark, root)
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{root}/{table}.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, found.fetchall()), key=str) == sorted((tuple(r) for r in df.select(*names).collect()), key=str)
