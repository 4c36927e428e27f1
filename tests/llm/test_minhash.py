"""Near-duplicates against brute force on full sets; signatures; components of odd graphs."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import minhash
from tessera.llm.components import components, hop


def brute(rows):
    sets = {}
    for k, (i, text) in enumerate(rows):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets[k] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    out = []
    for k, (i, _) in enumerate(rows):
        c = least.get(find(k)) if sets[k] else i
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out, key=str)


def varied(rng, base, edits):
    words = base[:]
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.random()}"
    return words


def test_documents_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "ONE\x0btwo"), (5, "one"), (None, "one two"), (6, "one two"), (6, "one two"), (7, "A\x1cb c d e f"), (8, "naïve É é ß"), (9, "naïve é é ß")]
    i = 20
    for _ in range(12):
        base = [f"x{rng.randrange(400)}" for _ in range(rng.choice([6, 40, 150, 400]))]
        for _ in range(rng.randint(1, 9)):
            rows.append((i, " ".join(varied(rng, base, rng.choice([0, 0, 1, 2, 4, 8])))))
            i += 1
    center = [f"c{k}" for k in range(200)]
    for _ in range(60):  # a star: each near the center, few near each other
        rows.append((i, " ".join(varied(rng, center, 5))))
        i += 1
    rows.append((i, " ".join(center)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("clash")).withColumn("cls", F.lit(1))
    got = minhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == brute(rows)
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_large_bucket_is_split_and_whole(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "SMALL", 3)
    rng = random.Random(4)
    base = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join(base + [f"q{k}_{j}" for j in range(rng.choice([2, 5, 12, 30]))])) for k in range(60)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == brute(rows)


def test_signature_counts_unlike_parts(spark):
    rng = np.random.default_rng(1)
    least = rng.integers(0, 1 << 32, (2, minhash.PERMUTATIONS), dtype=np.uint64).astype(np.uint32)
    least[1, :100] = least[0, :100]
    low = (least ^ (least >> np.uint32(16))) & np.uint32((1 << minhash.BITS) - 1)
    sig = minhash.packed(least).tolist()
    got = spark.createDataFrame([(sig[0], sig[1])], "a array<bigint>, b array<bigint>").select(minhash.unlike(F.col("a"), F.col("b")).alias("n")).first().n
    assert got == int((low[0] != low[1]).sum())


def test_components_of_chains_stars_and_rings(spark):
    links = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1100)] + [(2000 + k, 2000 + (k + 1) % 50) for k in range(50)] + [(5000, 5000)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len(got) == 301 + 100 + 50
    assert len({got[k] for k in range(301)}) == len({got[k] for k in range(1000, 1100)}) == len({got[k] for k in range(2000, 2050)}) == 1
    assert len(set(got.values())) == 3


def test_one_of_each_with_clashing_names(spark):
    rows = [(1, "a b c d e f", 5, "h", 1), (2, "a b c d e f", 6, "h", 2), (3, None, 7, "h", 3), (3, None, 7, "h", 3), (None, "x y", 8, "h", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, _text_hash string, _row int")
    got = minhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[2], rows[4]], key=str)


def test_batches_of_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, " ")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()) == [(1, 0, 1, True), (2, 0, 2, True), (2, 0, 2, True)]


def test_large_bucket_of_unlike_sets_fetches_no_sets(spark):
    rng, rows = np.random.default_rng(5), []
    bands = rng.integers(0, 1 << 40, (3000, 32))
    bands[:, 3] = 77
    for k in range(3000):
        cls = k.to_bytes(16, "big")
        sig = rng.integers(-(1 << 63), (1 << 63) - 1, 8).tolist() if k % 1000 else [5] * 8
        rows.append((77, cls, cls, 40, sig, bands[k].tolist()))
    marked = spark.createDataFrame(rows, "key long, cls binary, label binary, n long, sig array<long>, bands array<long>")
    dealt = minhash.dealt_blocks(marked.select("key", "cls", "label"))
    groups = {(r.i, r.j): r["count"] for r in dealt.groupBy("i", "j").count().collect()}
    assert max(groups.values()) < 3 * minhash.BLOCK
    found = minhash.block_candidates(dealt.join(marked.drop("key"), "cls"), 75, minhash.most_unlike(0.75)).collect()
    assert {bytes(r.cls) for r in found} == {k.to_bytes(16, "big") for k in (0, 1000, 2000)}


def test_the_largest_joined_group_meets_only_the_others(spark):
    rows = [(7, k.to_bytes(16, "big"), b"joined" if k < 2000 else k.to_bytes(16, "big")) for k in range(2010)]
    dealt = minhash.dealt_blocks(spark.createDataFrame(rows, "key long, cls binary, label binary"))
    assert dealt.count() == 2000 + 10 * (1 + -(-2000 // minhash.BLOCK))
    assert minhash.dealt_blocks(spark.createDataFrame(rows[:2000], "key long, cls binary, label binary")).count() == 0


def test_hop_joins_a_whole_star(spark):
    links = [(50, k) for k in range(100) if k != 50] + [(200, 201)]
    got = {r.node: r.label for r in hop(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(100), 0) | {200: 200, 201: 200}
