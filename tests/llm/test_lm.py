"""Language-model scores: gradients, proper distributions, windows, counts and mixture against brute force, held-out gain."""

import math
import os
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, lm
from tessera.llm.textkernels import blocks, mix, words_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"


def small(seed=1):
    rng = np.random.default_rng(seed)
    shapes = [(lm.CLASSES + 1, lm.DIM), (lm.WINDOW, lm.DIM), *[(lm.DIM, lm.DIM)] * 4, (lm.DIM, lm.INNER), (lm.INNER, lm.DIM), (lm.DIM, lm.GROUPS), (lm.GROUPS, lm.DIM, lm.MEMBERS)]
    of = np.arange(50257) % lm.CLASSES
    share = np.full(50257, -np.log10(50257 / lm.CLASSES))
    return lm.Model(of, share, rng.normal(0, 0.3, (lm.CLASSES + 1, lm.GROUPS)), rng.normal(0, 0.3, (lm.CLASSES + 1, lm.GROUPS, lm.MEMBERS)), [rng.normal(0, 0.3, s) for s in shapes])


def as_floats(model):
    return lm.Model(model.of, model.share, model.group.astype(np.float32), model.member.astype(np.float32), [p.astype(np.float32) for p in model.parts])


def test_gradients_equal_differences():
    model, rng = small(), np.random.default_rng(2)
    x, y = rng.integers(0, lm.CLASSES + 1, (2, 6)), rng.integers(0, lm.CLASSES, (2, 6))
    mask = rng.random((2, 4)) < 0.8
    y, run = y[:, 2:], lambda: lm.backward(x, y, mask, model, 2)
    _, grads = run()
    for p, g in zip(model.parts, grads, strict=True):
        for at in [tuple(rng.integers(0, n) for n in p.shape) for _ in range(3)] + [np.unravel_index(np.abs(g).argmax(), g.shape)]:
            old = p[at]
            p[at] = old + 1e-5
            up = run()[0]
            p[at] = old - 1e-5
            down = run()[0]
            p[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-4


def steps(model, count=64):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, lm.CLASSES + 1, (count, lm.WINDOW)), rng.integers(0, lm.CLASSES, (count, lm.FRESH))
    return x, y, rng.random(y.shape) < 0.9, model


def test_steps_use_their_arrays_again():
    """A step makes anew what is as large as the weights, not what is as large as its windows."""
    step = steps(as_floats(small()))
    lm.backward(*step)
    tracemalloc.start()
    lm.backward(*step)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 700_000


@pytest.mark.parametrize("large", (1, 40))
def test_steps_in_single_precision(large):
    """Also where a sum of attention overflows single precision, and on fewer windows after more."""
    model = as_floats(small())
    model.parts[2], model.parts[3] = model.parts[2] * np.float32(large), model.parts[3] * np.float32(large)
    exact = lm.Model(model.of, model.share, *(g.astype(np.float64) for g in (model.group, model.member)), [p.astype(np.float64) for p in model.parts])
    for count in (64, 5):
        x, y, mask, _ = steps(model, count)
        loss, grads = lm.backward(x, y, mask, model)
        want, true = lm.backward(x, y, mask, exact)
        assert loss == pytest.approx(want, rel=1e-4)
        for g, w in zip(grads, true, strict=True):
            assert g.dtype == np.float32 and np.abs(g - w).max() < 2e-3 * np.abs(w).max()


def test_flat_steps_equal_steps_by_part():
    one, two = as_floats(small()), as_floats(small())
    adam, flat = lm.Adam(one.parts, 0.01), lm.Flat(two.parts, 0.01)
    untouched = [p.copy() for p in two.parts]
    for k in range(3):
        grads = [np.random.default_rng(k).normal(0, 1, p.shape).astype(np.float32) for p in one.parts]
        adam.step(grads)
        flat.step(grads)
    assert all(np.array_equal(a, b) for a, b in zip(one.parts, flat.parts, strict=True))
    assert all(np.array_equal(a, b) for a, b in zip(two.parts, untouched, strict=True))


def test_scores_equal_a_slow_softmax_and_sum_to_one():
    model = small()
    head = np.array([5, 9, 40000])
    begin = [lm.CLASSES] * (lm.CONTEXT + 1)
    h = lm.forward(np.array([[*begin, *model.of[head]]]), model.parts)["h2"][0, -1]
    prev = model.of[head[-1]]
    norm = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    outer = norm(h @ model.parts[8] + model.group[prev])
    p = np.concatenate([outer[g] * norm(h @ model.parts[9][g] + model.member[prev, g]) for g in range(lm.GROUPS)])
    assert abs(p.sum() - 1) < 1e-9
    fast = as_floats(model)
    every = np.array([fast.score([np.append(head, i)])[0] for i in range(0, 50257, 997)]) - fast.score([head])[0]
    assert np.allclose(10**every, (p[model.of] * 10**model.share)[::997], rtol=1e-3)


def test_windows_and_pieces():
    for n, lead in ((1, 0), (23, 0), (24, 0), (25, 0), (57, 0), (200, 0), (33, 8), (9, 8), (100, 5)):
        _, first, keep = lm.windows(np.array([n]), np.array([lead]))
        assert sorted((first[:, None] + np.arange(lm.CONTEXT, lm.WINDOW))[keep].tolist()) == list(range(lead, n))
    model = as_floats(small())
    texts = [np.array([5, 9, 50256]), np.arange(100) % 7, np.array([50256])]
    alone = np.concatenate([model.score([t]) for t in texts])
    assert np.allclose(model.score(texts), alone, atol=1e-3)


def test_weights_that_overflow_are_scored_with_care():
    model = as_floats(small())
    texts = [np.arange(60), np.array([7, 50256])]
    want = model.score(texts)
    before = np.full((1, lm.WINDOW), 3)
    used, target = np.ones((1, lm.FRESH), bool), np.arange(lm.FRESH)
    assert np.allclose(lm.careful(model, before, used, target), lm.Workspace(model).log_shares(before, used, target), atol=1e-3)
    model.parts[8] = model.parts[8] * np.float32(1e4)
    assert np.isfinite(model.score(texts)).all() and np.isfinite(want).all()


def test_classes_and_shares():
    counts = np.random.default_rng(1).zipf(1.3, 50257).clip(0, 10**9)
    starts = np.arange(50257) % 3 == 0
    of = lm.classes_of(counts, starts)
    assert set(of.tolist()) == set(range(lm.CLASSES)) and np.bincount(of)[of[-1]] == 1
    pairs = np.zeros((lm.CLASSES + 1, lm.CLASSES), np.int64)
    pairs[3, 4] = 40
    model = lm.start_model(counts, pairs, of)
    assert np.allclose(np.bincount(of, 10.0**model.share, lm.CLASSES), 1)
    assert np.allclose(np.exp(model.group).sum(1), 1, atol=1e-4) and np.allclose(np.exp(model.member).sum(2), 1, atol=1e-4)
    assert np.exp(model.group[3, 0]) * np.exp(model.member[3, 0, 4]) > 0.5


def test_words_are_encoded_each_by_itself():
    words = ["an", "don't", "'s", "x ", "  y", "　", "漢字🙂", "<|endoftext|>", "12a", "\x1c", "é", " "]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = words_of(data)
    flat, per = lm.encode_words(data, starts, ends, PATH)
    own = bpe.load(PATH)
    own_ids = [[i for part in ([" ", w] if w in own.special else [" " + w]) for i in own.encode(part).tolist()] for w in words]
    found = [x.tolist() for x in np.split(flat, np.cumsum(per)[:-1])]
    assert [f for f, w in zip(found, words, strict=True) if w not in own.special] == [f for f, w in zip(own_ids, words, strict=True) if w not in own.special]
    assert own.decode(flat) == "".join(" " + w for w in words)


def test_remembered_words(monkeypatch):
    monkeypatch.setattr(lm, "REMEMBERED", 6)
    memory = lm.Remembered(PATH)
    for words in (["an", "the", "x"], ["the", "of", "an", "here"], ["an"], [], ["é", "漢字", "of", "p", "q", "the"], ["an", "zzz"]):
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        starts, ends, keys = words_of(data)
        got, want = memory.ids(keys, data, starts, ends), lm.encode_words(data, starts, ends, PATH)
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_packed_numbers():
    for a in (np.zeros(0, np.int64), np.array([0, 1, -1, 2**31 - 1]), np.arange(70000) % 300):
        assert lm.spread(lm.squeezed(a)).tolist() == a.tolist()


SYLLABLES = "an th er on in re ti ed nd ha".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(4)
    rows = [(k, prose(rng, rng.randint(1, 150)), 1) for k in range(400)]
    rows += [(None, None, 1), (901, "", 1), (902, " \n", 2), (903, "Ä ä THE the\x0bThe <|endoftext|> \x1c     x ", 3), (904, "x" * 5000, 1), (5, rows[5][1], 1)]
    rows += [(1000 + k, rows[k][1], 1) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk int").withColumn("held_out", F.lit("x")).withColumn("pos", F.lit(1))
    return rows, docs, lm.score_texts(docs, PATH).collect()


def held(i):
    return zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0


def words(t):
    return [*(t or "").encode().lower().split(), None]


def test_base_equals_brute_force(scored):
    rows, _, out = scored
    c = Counter(w for i, t, _ in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), 6)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want


def slow_phrases(t):
    """The phrases of a text, by the rule of their ends, word by word."""
    data = np.frombuffer((t or "").lower().encode() + b" ", np.uint8)
    hashes = [lm.END_HASH, *words_of(data)[2], lm.END_HASH]
    out, now = [], []
    for before, h in zip(hashes[:-1], hashes[1:], strict=True):
        now.append(int(h))
        if h == lm.END_HASH or mix(np.array([before * np.uint64(0x5851F42D4C957F2D) + h]))[0] % np.uint64(lm.PHRASE) == 0:
            out.append(tuple(now))
            now = []
    return out


@pytest.mark.filterwarnings("ignore:overflow")
def test_mixture_equals_brute_force(spark, scored, monkeypatch):
    rows, docs, out = scored
    caught = {}
    real = lm.fitted
    monkeypatch.setattr(lm, "fitted", lambda *a: caught.setdefault("m", real(*a)))
    monkeypatch.setattr(lm, "CHUNK", 3000)
    monkeypatch.setattr(lm, "STRETCH", 40)
    again = lm.score_texts(docs.repartition(3), PATH).collect()
    m = caught["m"]
    key = lambda r: (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6))
    assert sorted(map(key, again)) == sorted(map(key, out))

    train = [t for i, t, _ in rows if not held(i)]
    c = Counter(w for t in train for w in words(t))
    by_doc = [Counter(slow_phrases(t)) for _, t, _ in rows]
    phrases = sum((d for (i, _, _), d in zip(rows, by_doc, strict=True) if not held(i)), Counter())
    assert (m.words, m.kinds, m.phrases) == (sum(c.values()), len(c), sum(phrases.values()))
    assert m.known == lm.COUNTED
    assert m.kept == pytest.approx((sum(x for x in phrases.values() if x > 1) + 1) / (m.phrases + 2))

    want = defaultdict(list)
    for (i, t, _), mine in zip(rows, by_doc, strict=True):
        ids = lm.subwords([t], PATH)[0]
        logs = m.model.log_ids(ids, np.array([len(ids)]), np.array([0]))
        at, place, total = 0, 0, 0.0
        every = words(t)
        for phrase in slow_phrases(t):
            spelled = 0.0
            for _ in phrase:
                w = every[place]
                n = 1 if w is None else len(lm.subwords([w.decode()], PATH)[0]) - 1
                spelled += np.logaddexp(np.log(max(1e-300, c[w] * m.known / m.words)), logs[at : at + n].sum() * np.log(10) + np.log(1 - m.known))
                at, place = at + n, place + 1
            others = phrases[phrase] - (0 if held(i) else mine[phrase])
            total += np.logaddexp(np.log(others * m.kept / m.phrases) if others else -np.inf, spelled + np.log(1 - m.kept))
        want[str(i)].append(total / np.log(10))
    got = defaultdict(list)
    for r in again:
        got[str(r.doc_id)].append(r.score)
    for i in want:  # the text that goes on from stretch to stretch has less context there
        assert np.allclose(sorted(got[i]), sorted(want[i]), rtol=0.02, atol=0.5), i


def test_model_beats_word_counts_on_held_out_texts(scored):
    rows, _, out = scored
    mine = [r for r in out if r.held_out and r.doc_id is not None and 0 <= r.doc_id < 900]
    assert sum(r.score for r in mine) > sum(r.base_score for r in mine)
    assert all(np.isfinite(r.score) and r.score < 0 for r in out)


def test_texts_that_occur_twice_are_told_apart(scored):
    rows, _, out = scored
    by_id = {r.doc_id: r for r in out}
    twice = [by_id[k].score / by_id[k].n_tokens for k in range(40) if k != 5 and not held(k) and not held(1000 + k)]
    once = sorted(by_id[k].score / by_id[k].n_tokens for k in range(40, 400))
    assert sum(x > once[int(0.95 * len(once))] for x in twice) >= 0.9 * len(twice)


def test_training_lowers_the_loss():
    rng = random.Random(6)
    data, offsets = next(b[1:] for b in blocks(lm.pa.array([prose(rng, 300) for _ in range(60)]), 1 << 22))
    row = lm.encoded(data, offsets, np.ones(60, bool), PATH) | {"held": [False] * 60}
    counts = lm.spread(row["tokens"])
    of = lm.classes_of(counts, np.arange(50257) % 2 == 0)
    classes, lengths = lm.training_classes(row, of)
    model = lm.start_model(counts, np.zeros((lm.CLASSES + 1, lm.CLASSES)), of)
    ids, n = lm.text_ids(row)
    before = model.score(np.split(ids, np.cumsum(n)[:-1])).sum()
    adam = lm.Adam(model.parts, lm.RATE)
    for turn in range(lm.ROUNDS):
        lm.learn(model, adam, classes, lengths, turn, lm.RATE)
    assert model.score(np.split(ids, np.cumsum(n)[:-1])).sum() > 0.85 * before


def test_every_window_is_trained_once(monkeypatch):
    seen = Counter()
    monkeypatch.setattr(lm, "backward", lambda x, y, mask, model: seen.update(map(tuple, np.concatenate([x, y], 1).tolist())) or (0.0, model.parts))
    monkeypatch.setattr(lm.Adam, "step", lambda self, grads: None)
    lengths = np.array([5, 700, 33])
    classes = np.random.default_rng(1).integers(0, lm.CLASSES, lengths.sum())
    for turn in range(lm.ROUNDS):
        lm.learn(small(), lm.Adam([], 0.1), classes, lengths, turn, 0.1)
    assert set(seen.values()) == {1} and len(seen) == len(lm.windows(lengths, np.zeros(3, np.int64))[0])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_attention_carries_the_score(spark):
    """Of the held-out texts: without attention at least a twentieth of the log probability is lost, and counts only add to it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chunks = lm.chunked(docs, PATH, "doc_id", "text", 10)
    totals = lm.totals_of(chunks)
    mixture = lm.fitted(chunks, totals, PATH)
    found = defaultdict(list)
    for r in totals.collect():
        found[r.chunk].append((r.pos, r.total))
    rows = [r.asDict() for r in chunks.collect()]

    def held_out(mixture):
        out = 0.0
        for row in rows:
            pos, total = (np.array(x, np.int64) for x in (zip(*sorted(found[row["chunk"]]), strict=True) if found[row["chunk"]] else ((), ())))
            out += mixture.scored(row, pos, total)[3][np.array(row["held"], bool)].sum()
        return out

    full = held_out(mixture)
    plain = lm.Model(mixture.model.of, mixture.model.share, mixture.model.group, mixture.model.member, [*mixture.model.parts[:8], *(np.zeros_like(p) for p in mixture.model.parts[8:])])
    assert held_out(replace(mixture, model=plain)) < 1.05 * full
    assert held_out(replace(mixture, known=1e-12, kept=1e-12)) < full


def test_empty_and_held_out_tables(spark, scored):
    assert lm.score_texts(scored[1].limit(0), PATH).collect() == []
    only = next(k for k in range(100) if held(k))
    (r,) = lm.score_texts(spark.createDataFrame([(only, "some words")], "doc_id long, text string"), PATH).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and np.isfinite(r.score)


def test_very_long_text(spark):
    text = "an the " * 400_000
    (r,) = lm.score_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).collect()
    assert (r.n_tokens, r.n_known) == (800_001, 800_001) and np.isfinite(r.score)
