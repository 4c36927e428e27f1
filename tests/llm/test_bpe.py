"""BPE against the tokenizers library: whole texts, odd characters, long words, nulls."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [*"aZé ß\t\n\x1c\x85²½٣Ⅷ漢🙂́​﻿\u0000’ªº¹.,_-0123'", "<|endoftext|>", "'ll", " the", " \n\n ", " nation", "   "]


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


def test_random_texts_equal_the_library(theirs):
    rng, own = random.Random(5), bpe.Bpe(PATH)
    for _ in range(1500):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40)))
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        assert own.decode(np.array(ids)) == theirs.decode(ids, skip_special_tokens=False)


def test_decode_of_any_ids_equals_the_library(theirs):
    rng, own = random.Random(6), bpe.Bpe(PATH)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(9)]
        assert own.decode(np.array(ids)) == theirs.decode(ids, skip_special_tokens=False)


def test_scan_and_heap_agree():
    ranks, rng = bpe.load(PATH).ranks, random.Random(7)
    for word in [b"", b"a", b"ab" * 400, bytes(rng.choice(b"aehrst") for _ in range(700)), "éà".encode() * 90]:
        assert bpe.merge_scan(word, ranks) == bpe.merge_heap(word, ranks)


def test_documents_with_nulls_repeats_and_clashing_names(spark, theirs):
    rows = [(1, None, "x", 5), (2, "", "y", None), (3, "the nation's thing", None, 1), (3, "the nation's thing", None, 1), (None, "a" * 30_000, "z", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    out = bpe.encode_documents(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in out) == sorted((i or 0, len(theirs.encode(t or "", add_special_tokens=False).ids), t or "") for i, t, *_ in rows)
    assert bpe.digest_documents(docs, PATH).count() == 5
    assert bpe.digest_documents(docs.limit(0), PATH).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
