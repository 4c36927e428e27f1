"""Line labelling: counts against brute force, Viterbi against enumeration, the likelihood's gradients, retention."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import quality_rules as rules
from tessera.llm.textkernels import blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    runs = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(runs)
    covered = {k + j for k, r in enumerate(runs) if often[r] > 1 for j in range(5)}
    seen, double = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            double += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), double, len(covered), n < 10 or 100 * len(covered) > 20 * n


def texts():
    rng = random.Random(1)
    pool = ["a", "b", "éa", "漢字", "#x", "|", "\n", "\n", " \n", "\r\n", "\x0b", "\x1c", "\x85", "  ", "🙂", "<b>"]
    out = [None, "", "\n\n", "one\none\none ", "a b c d e a b c d e", "w " * 50, "x" * 3000]
    out += ["".join(rng.choice(pool) + rng.choice(["", " "]) for _ in range(rng.randint(1, 120))) for _ in range(300)]
    return out


def test_counts_equal_brute_force(spark):
    rows = [(k, t, 1) for k, t in enumerate(texts())] + [(None, "a b", 2), (3, "one\none\none ", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int").withColumn("n_words", F.lit("x"))
    field = rules.fit([], np.zeros(0, np.int64))
    got = sorted((tuple(r)[:7] + (r.kept,) for r in rules.judge_documents(docs, field).collect()), key=str)
    want = sorted(((i, *b[:5], b[5], not b[5]) for i, b in ((i, brute(t)) for i, t, _ in rows)), key=str)
    assert got == want
    assert rules.judge_documents(docs.limit(0), field).collect() == []


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = rng.integers(1, 8)
        field = rules.Crf(rng.normal(size=(rules.FEATURES, 2)), rng.normal(size=(2, 2)))
        x = rng.normal(size=(n, rules.FEATURES))
        lines = rules.Lines(x, np.ones(n), np.array([0, n]), np.zeros((1, 5)))
        e = x @ field.weights
        value = lambda y: sum(e[k, s] for k, s in enumerate(y)) + sum(field.turn[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        assert abs(value(field.labels(lines)) - max(map(value, itertools.product((0, 1), repeat=int(n))))) < 1e-9


def test_likelihood_and_gradients_equal_enumeration():
    rng = np.random.default_rng(3)
    x, mask = rng.normal(size=(3, 5, rules.FEATURES)), np.arange(5)[None] < np.array([5, 3, 1])[:, None]
    y, each = rng.integers(0, 2, (3, 5)).astype(float), rng.random(3)
    w, t = rng.normal(size=(rules.FEATURES, 2)), rng.normal(size=(2, 2))

    def exact(w, t):
        total = 0
        for c in range(3):
            n = mask[c].sum()
            e = x[c] @ w
            value = lambda s: sum(e[k, int(v)] for k, v in enumerate(s)) + sum(t[int(a), int(b)] for a, b in itertools.pairwise(s))  # noqa: B023, E731
            total += each[c] * (value(y[c, :n]) - np.log(sum(np.exp(value(s)) for s in itertools.product((0, 1), repeat=int(n)))))
        return total

    value, gw, gt = rules.likelihood(w, t, x, mask, y, each)
    assert abs(value - exact(w, t)) < 1e-9
    for g, p in ((gw, w), (gt, t)):
        for at in itertools.product(*map(range, p.shape)):
            old = p[at]
            p[at] = old + 1e-5
            up = exact(w, t)
            p[at] = old - 1e-5
            down = exact(w, t)
            p[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_boilerplate_is_told_from_content():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["an", "th", "er", "on", "re"]) for _ in range(rng.randint(1, 3)))
    good = lambda: "\n".join(" ".join(word() for _ in range(rng.randint(5, 20))).capitalize() + "." for _ in range(rng.randint(2, 12)))
    bad = lambda: "\n".join(" | ".join(word() for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(2, 12)))
    field = rules.fit([good() for _ in range(150)] + [bad() for _ in range(150)], np.array([1] * 150 + [0] * 150))
    parts = [good(), bad(), good() + "\n" + good() + "\nHome | About | Help"]
    share = np.concatenate([field.content(rules.lines_of(d, o)) for _, d, o in blocks(pa.array(parts))])
    assert share[0] > 0.9 > 0.1 > share[1] and 0.7 < share[2]
