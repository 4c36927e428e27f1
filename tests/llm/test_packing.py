"""Packing: ids against the tokenizers library, cuts, gapless sequences, fullest bins against brute force."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [*"aZé ß\t\n\x1c\x85²½٣Ⅷ漢🙂́​﻿\u0000’ªº¹.,_-0123'", "<|endoftext|>", "'ll", " the", " \n\n ", " nation", "   "]


def test_ids_equal_the_library():
    theirs, rng = Tokenizer.from_file(PATH), random.Random(8)
    for _ in range(1500):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40)))
        assert packing.encoding(PATH).encode_to_numpy(text, allowed_special="all").tolist() == theirs.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(40))
def test_fullest_equals_brute_force(seed):
    rng = random.Random(seed)
    counts = [0] + [rng.choice([0, 0, 1, 2]) for _ in range(12)]
    room = rng.randint(1, 30)
    ranges = [range(min(c, room // n) + 1) if n else range(1) for n, c in enumerate(counts)]
    best = max(s for s in (sum(n * k for n, k in enumerate(x)) for x in itertools.product(*ranges)) if s <= room)
    used = packing.fullest(counts, room, 12)
    assert sum(n * k for n, k in used) == best
    assert all(0 < k <= counts[n] for n, k in used)


def test_recipes_use_every_piece_and_few_bins():
    rng = random.Random(2)
    histogram = {n: rng.randint(1, 400) for n in range(1, 2049) if rng.random() < 0.5}
    found = packing.recipes(histogram)
    used = {}
    for times, parts in found:
        assert sum(n * k for n, k in parts) <= 2048
        for n, k in parts:
            used[n] = used.get(n, 0) + times * k
    assert used == histogram
    assert sum(t for t, _ in found) <= 1.03 * sum(n * c for n, c in histogram.items()) / 2048


def test_documents_are_packed_without_gaps(spark):
    rng, theirs = random.Random(9), Tokenizer.from_file(PATH)
    rows = [(None, None, 1), (1, "", 2), (2, "x" * 9000, 3), (3, " the" * 63, 4), (4, " the" * 64, 4), (5, " the" * 128, 4)] + [(7, "same words here", 5)] * 30
    rows += [(k, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(0, 90))), 6) for k in range(10, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").withColumn("_part", F.lit(1))
    got = packing.pack_documents(docs, PATH, 64).collect()
    lengths = sorted(len(theirs.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    assert sum(r.length for r in got) == sum(lengths)
    for r in got:
        assert r.length == 64 or r.piece == 0
    for sequence, parts in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in parts:
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert len({r.sequence_id for r in got}) <= -(-sum(lengths) // 64) + 1
    one = next(r for r in got if r.doc_id == 2 and r.piece == 1)
    ids = np.array(theirs.encode("x" * 9000, add_special_tokens=False).ids + [0], "<u4")
    assert one.ids_crc32 == zlib.crc32(ids[one.start : one.start + one.length].tobytes())
    assert packing.pack_documents(docs.limit(0), PATH, 64).collect() == []


@pytest.mark.parametrize("text", [" " * 2_000_000 + "x", "a" + "\n" * 100_000, "é" * 50_000])
def test_very_long_texts(spark, text):
    theirs = Tokenizer.from_file(PATH)
    found = packing.ids_of(text, PATH).tolist()
    assert theirs.decode(found, skip_special_tokens=False) == text
    assert found == bpe.load(PATH).encode(text).tolist()
    got = packing.pack_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).collect()
    assert sum(r.length for r in got) == len(found) + 1


def test_slow_fall_back_gives_the_same_ids(monkeypatch):
    def fails(*_, **__):
        raise ValueError("too deep")

    text = "Some words,  <|endoftext|>\n and 12 more   é"
    want = packing.ids_of(text, PATH).tolist()
    monkeypatch.setattr(packing, "encoding", lambda _: type("E", (), {"encode_to_numpy": fails})())
    assert packing.ids_of(text, PATH).tolist() == want
