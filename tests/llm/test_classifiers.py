"""Toxicity and quality: held-out accuracy, unseen spellings, odd rows, one label only, empty tables."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, toxicity
from tessera.llm import textkernels as kernels
from tessera.llm.fitting import fold
from tessera.llm.textkernels import blocks

SYLLABLES = "an th er on in re ti ed nd ha ou es st en at to nt is or".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def toxic(rng, n, stem="grumpf"):
    words = prose(rng, n).split()
    words.insert(rng.randrange(len(words)), rng.choice(["vilest", stem + "".join(rng.choice(SYLLABLES) for _ in range(2))]))
    return " ".join(words)


def corpus(rng, n):
    rows = []
    for k in range(n):
        bad = k % 3 == 0
        rows.append((k, (toxic if bad else prose)(rng, rng.randint(5, 200)), int(bad)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus(random.Random(1), 900)
    docs = spark.createDataFrame([(i, t, "s", 1.5) for i, t, _ in rows] + [(None, None, "s", 1.0), (9001, "", "s", 1.0), (9002, " \n", "s", 1.0), (9003, prose(random.Random(2), 60_000), "s", 1.0), (5, rows[5][1], "s", 1.0)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, 1 - y, y) for i, _, y in rows] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def test_toxicity_of_held_out_documents(tables):
    docs, labels, truth = tables
    out = toxicity.score_documents(docs, toxicity.fit_on(docs, labels)).withColumn("held_out", fold("doc_id", 5) == 0).collect()
    assert len(out) == 905 and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.95
    assert next(r for r in out if r.doc_id == 9003).score < 0.5
    assert next(r for r in out if r.doc_id == 9001).score < 0.5


def test_unseen_spellings_share_ngrams():
    rng = random.Random(4)
    rows = corpus(rng, 900)
    model = toxicity.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    texts = [prose(rng, 40) + " grumpfzzq " + prose(rng, 40), prose(rng, 80)]
    found = np.concatenate([model.score_block(*toxicity.padded(d, o)) for _, d, o in blocks(pa.array(texts))])
    assert found[0] > 0.5 > found[1]


def junk(rng, n):
    if rng.random() < 0.5:
        return " ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in prose(rng, n).split())
    return " ".join([prose(rng, 1)] * n)


def test_quality_of_held_out_documents(spark):
    rng = random.Random(3)
    rows = [(k, (junk if k % 4 == 0 else prose)(rng, rng.randint(30, 150)), int(k % 4 != 0)) for k in range(800)]
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(None, None, 1), (9001, "", 1), (9002, "x " * 200_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    out = quality.score_documents(docs, quality.fit_on(docs, labels)).withColumn("held_out", fold("doc_id", 5) == 0).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(out) == 803 and all(0 <= r.score <= 1 for r in out)
    assert np.mean([(r.score >= 0.3) == truth[r.doc_id] for r in held]) > 0.88


@pytest.mark.parametrize("module", [toxicity, quality])
def test_one_label_or_no_rows(spark, module, tables):
    docs, labels, _ = tables
    one = labels.where("toxic = 1").select("doc_id", F.lit(1).alias("quality"), "toxic")
    assert {r.score for r in module.score_documents(docs, module.fit_on(docs, one)).collect()} == {1.0}
    assert {r.score for r in module.score_documents(docs, module.fit_on(docs, labels.limit(0))).collect()} == {0.0}
    assert module.score_documents(docs.limit(0), module.fit_on(docs.limit(0), labels)).collect() == []


def slow_hash(word: bytes) -> int:
    """A run of bytes as the kernels hash it before mixing, in Python's own numbers."""
    return sum(int(kernels._values[b]) * pow(int(kernels.BASE), k, 1 << 64) for k, b in enumerate(word)) % (1 << 64)


def mixed(v: int) -> int:
    return int(kernels.mix(np.array([v % (1 << 64)], np.uint64))[0])


@pytest.mark.filterwarnings("ignore:overflow")
def test_toxicity_equals_a_slow_reading():
    rng, draw = random.Random(11), np.random.default_rng(11)
    model = toxicity.Model(draw.normal(size=1 << toxicity.BUCKET_BITS), -0.7)
    texts = [prose(rng, n) for n in (1, 2, 4, 5, 9, 40)] + ["A B\tÉé x\x0bY", "", " \n"]
    for text in texts:
        words = [w for w in text.encode().lower().split()]
        each = []
        for w in words:
            padded = b" " + w + b" "
            grams = [padded[i : i + n] for n in toxicity.SIZES for i in range(len(padded) - n + 1)]
            each.append(np.mean([model.gain[mixed(slow_hash(g) + len(g)) >> (64 - toxicity.BUCKET_BITS)] for g in grams]) if grams else 0.0)
        tops = [np.mean(each[i : i + toxicity.WINDOW]) for i in range(max(1, len(each) - toxicity.WINDOW + 1))] if each else [0.0]
        (got,) = toxicity.scores(model, pa.array([text]))
        assert got == pytest.approx(1 / (1 + np.exp(-(max(tops) + model.bias))), abs=1e-9)


def test_a_word_in_front_does_not_change_a_toxic_phrase():
    model = toxicity.Model(np.random.default_rng(5).normal(size=1 << toxicity.BUCKET_BITS), 0.0)
    phrase = "some four words here"
    logit = lambda t: (lambda p: np.log(p / (1 - p)))(toxicity.scores(model, pa.array([t]))[0])
    assert all(logit(" ".join(["x"] * k) + " " + phrase) >= logit(phrase) - 1e-9 for k in range(6))


@pytest.mark.filterwarnings("ignore:overflow")
def test_quality_equals_a_slow_reading():
    rng, draw = random.Random(12), np.random.default_rng(12)
    texts = [prose(rng, 30), "Ab 12 ***!! x9 ABC\té", "", "a a a"]
    known = np.sort(np.array([mixed(slow_hash(w.encode()) + len(w.encode())) for w in ("an", "a", "***!!", "ABC", "the")], np.uint64))
    n = 2 * quality.DIM + 4
    layers = [draw.normal(size=s).astype(np.float32) for s in ((n, quality.HIDDEN), (quality.HIDDEN,), (quality.HIDDEN, 1), (1,))]
    model = quality.Model(known, draw.normal(size=(len(known) + quality.SHAPES, quality.DIM)).astype(np.float32), draw.normal(size=n), np.abs(draw.normal(size=n)) + 0.5, layers, 1.7)
    for text in texts:
        tokens = [m.group().encode() for m in re.finditer(r"[A-Za-z0-9\u0080-\U0010ffff]+|[^A-Za-z0-9\u0080-\U0010ffff\x09-\x0d ]+", text)]
        rows, signs, capitals = [], 0, 0
        for t in tokens:
            h = mixed(slow_hash(t) + len(t))
            sign = not (t[:1].isalnum() or t[0] >= 128)
            upper, digits = sum(65 <= b < 91 for b in t), sum(48 <= b < 58 for b in t)
            form = 4 if sign else 3 if digits else 0 if not upper else 2 if upper == len(t) else 1
            at = np.flatnonzero(known == np.uint64(h))
            rows.append(int(at[0]) if len(at) else len(known) + form * 16 + min(len(t), 15))
            signs, capitals = signs + sign, capitals + (form == 2)
        x = np.zeros(n)
        if tokens:
            x[: quality.DIM] = model.vectors[rows].mean(0)
            x[quality.DIM : 2 * quality.DIM] = model.vectors[sorted(set(rows))].mean(0)
            x[2 * quality.DIM :] = np.log1p(len(tokens)), np.log(len(set(tokens)) / len(tokens)), signs / len(tokens), capitals / len(tokens)
        h = np.maximum((x - model.center) / model.spread @ layers[0] + layers[1], 0)
        (got,) = quality.scores(model, pa.array([text]))
        assert got == pytest.approx(1 / (1 + np.exp(-(h @ layers[2] + layers[3])[0] / model.temperature)), abs=1e-3)


def test_temperature_comes_from_documents_kept_apart():
    rng = random.Random(13)
    texts, y = zip(*[((junk if k % 4 == 0 else prose)(rng, 60), int(k % 4 != 0)) for k in range(200)], strict=True)
    assert quality.fit(list(texts), np.array(y)).temperature != 1.0
    few = quality.fit([prose(rng, 60), junk(rng, 60)], np.array([1, 0]))
    assert few.temperature == 1.0 and np.isfinite(quality.scores(few, pa.array(["a b", None]))).all()


def test_very_long_text_is_scored_in_stretches(monkeypatch):
    rng = random.Random(14)
    model = toxicity.Model(np.random.default_rng(3).normal(size=1 << toxicity.BUCKET_BITS), 0.2)
    text = prose(rng, 3000)
    whole = toxicity.scores(model, pa.array([text]))
    monkeypatch.setattr(toxicity, "BLOCK", 500)
    assert toxicity.scores(model, pa.array([text])) == pytest.approx(whole)
