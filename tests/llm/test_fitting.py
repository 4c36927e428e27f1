"""The bounded samples: one text too large, one row repeated, classes of uneven size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.fitting import chosen, fold, labelled_sample, text_sample


def first_ids(spark, label, n=400):
    """Ids outside fold 0 in the order in which the sample picks them."""
    return [r.id for r in spark.range(n).where(fold("id", 5) != 0).orderBy(F.xxhash64(F.lit(label), "id")).collect()]


@pytest.mark.parametrize("large", [5000, 20_000])
def test_a_large_text_keeps_no_other_out(spark, large):
    texts = {i: f"text {i} " + "x" * 20 for i in range(400)}
    hashed = lambda i, t: spark.range(1).select(F.xxhash64(F.lit("toxic"), F.lit(i).cast("long"), F.lit(t)).alias("h")).first().h
    low = min(hashed(i, texts[i]) for i in first_ids(spark, "toxic")[:40])
    i = first_ids(spark, "toxic")[0]
    # A text whose row is the first of all: a few of its kind are tried.
    some = spark.range(1000).select(F.concat(F.col("id").cast("string"), F.lit(" " + "y" * large)).alias("t"))
    texts[i] = some.orderBy(F.xxhash64(F.lit("toxic"), F.lit(i).cast("long"), "t")).first().t
    assert hashed(i, texts[i]) < low
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, "toxic", 150, 10_000).collect()
    assert sum(len(r.text) for r in got) <= 10_000
    assert min(sum(r.y == y for r in got) for y in (0, 1)) > 100


def test_a_repeated_row_counts_once(spark):
    rows = [(i, f"text {i}") for i in range(300)]
    for sample in ("toxic", "sample"):
        hot = first_ids(spark, sample)[0]
        docs = spark.createDataFrame(rows + [rows[hot]] * 10_000, "doc_id long, text string")
        if sample == "toxic":
            got = labelled_sample(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"), "toxic", 60, 1 << 20).collect()
            assert sorted(sum(r.y == y for r in got) for y in (0, 1)) == [60, 60]
        else:
            got = text_sample(docs, 100, 1 << 20).collect()
            assert len(got) == 100
        assert len({r.text for r in got}) == len(got)


def test_text_sample_passes_over_a_large_text(spark):
    docs = spark.createDataFrame([(i, "z" * (50_000 if i % 3 == 0 else 30)) for i in range(200)], "doc_id long, text string")
    got = text_sample(docs, 100, 10_000).collect()
    assert 50 <= len(got) <= 80 and all(len(r.text) == 30 for r in got)


def test_shares_of_classes():
    y = np.array([0, 1] * 100)
    size = np.where(y == 1, 10, 100)
    taken = chosen(size, y, 5000)
    assert taken[y == 1].all() and size[taken].sum() == 5000
    only = chosen(np.full(100, 100), np.zeros(100, np.int64), 5000)
    assert only.sum() == 50 and only[:50].all()
    assert chosen(np.array([9000, 10]), np.array([0, 0]), 5000).tolist() == [False, True]
    assert chosen(np.zeros(0, np.int64), np.zeros(0, np.int64), 5000).tolist() == []
