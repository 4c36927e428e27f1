"""The pipeline's stages, each on its own input, against their operators and brute force."""

import random

import pytest
from pyspark.sql import functions as F
from test_classifiers import junk, prose, toxic
from test_minhash import brute

import corpus_pipeline


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(900):
        kind = rng.choice(["good", "good", "good", "toxic", "junk"])
        text = {"good": prose, "toxic": toxic, "junk": junk}[kind](rng, rng.randint(20, 120))
        rows.append((k, text, "en", "s", len(text)))
        labels.append((k, int(kind != "junk"), int(kind == "toxic")))
    for j in range(40):
        words = rows[j * 3][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + j, " ".join(words), "en", "s", None))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s", 0), rows[0], (None, "no id but words enough to be here", "en", "s", 1)]
    root = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_stages_in_turn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    first, second, third, last = (f for _, f in corpus_pipeline.STAGES)

    good = first(spark, docs, sf_dir).cache()
    assert good.columns == docs.columns
    assert sum(truth.get(r.doc_id, (1, 0))[0] for r in good.collect()) > 0.9 * good.count()
    clean = second(spark, good, sf_dir).cache()
    assert clean.columns == docs.columns
    assert sum(truth.get(r.doc_id, (1, 0))[1] for r in clean.collect()) < 0.05 * clean.count()

    once = third(spark, clean, sf_dir).cache()
    assert once.columns == docs.columns
    want = {(i, c) for i, _, c, kept in brute([(r.doc_id, r.text) for r in clean.collect()]) if kept}
    assert sorted((r.doc_id for r in once.collect()), key=str) == sorted((i for i, _ in want), key=str)

    out = last(spark, once, sf_dir)
    assert out.select("doc_id").distinct().count() == once.select("doc_id").distinct().count()
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


def test_clashing_names_long_texts_and_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = spark.createDataFrame([(5000, "ha " * 400_000, "en", "s", 1), (5001, "ha " * 400_000, "en", "s", 1)], docs.schema)
    more = docs.limit(40).union(long).withColumns({"_id": F.lit("x"), "_text_hash": F.lit(1), "cls": F.lit(2), "label": F.lit(None).cast("int")})
    at = more
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf_dir).cache()
        assert at.columns == more.columns
    assert at.where("doc_id IN (5000, 5001)").count() <= 1
    assert corpus_pipeline.STAGES[-1][1](spark, at, sf_dir).select("doc_id").distinct().count() == at.select("doc_id").distinct().count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, more.limit(0), sf_dir).count() == 0
