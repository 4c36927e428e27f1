"""Near-duplicate documents by b-bit MinHash.

Each document keeps PERMUTATIONS minima of its shingle set. Whole minima, in bands of ROWS, only make
candidates; of each minimum the lowest BITS bits stay, packed into longs. Equal bits of two signatures are
counted with exclusive-or and bit counts, and the count is corrected for chance collisions:
similarity = (share - 2**-BITS) / (1 - 2**-BITS). Pairs whose estimate lies more than SIGMAS standard
deviations under the threshold are dropped; the others are confirmed on their full sets.

A pair at the threshold of 0.75 shares no band with probability (1 - 0.75**4)**32 = 5e-6, and is
estimated too low with probability 3e-7. No bucket is capped and no candidate dropped for its number:

- documents with equal sets are one class, and only classes are compared;
- each bucket first compares its members with one of them, drawn anew for each bucket, which joins the
  members of a true group in a number of pairs linear in its size;
- pairs of a bucket of at most SMALL members that are not yet joined follow by a join on the bucket;
- larger buckets whose members are not all joined are dealt into pairs of blocks of about BLOCK members each; the
  members of its largest joined group only meet the others, so one true group costs no blocks, however large. A
  first pass has signatures alone and finds by bit counts who has a candidate in a pair of blocks; only those
  come back with their full sets, to be confirmed on the spot, unless both are joined already. Only links become
  rows. A pair is compared in the first of its buckets only.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components, hop
from .shared import cut
from .textkernels import blocks, document_words, mix, shingle_sets

PERMUTATIONS, ROWS, BITS, SIGMAS = 128, 4, 4, 5
SMALL, BLOCK = 64, 1024
#: So many class ids are broadcast at most, to pick their texts in the scan; more of them go by a shuffle join.
BROADCAST_IDS = 1_000_000

_factors, _shifts = (mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(k)).astype(np.uint32) for k in (0x51ED27, 0x2545F5))
_factors |= np.uint32(1)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The PERMUTATIONS minima of a set of hashes that is not empty."""
    x, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        np.minimum(out, (x[k : k + 2048, None] * _factors + _shifts).min(0), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of the minima (documents x PERMUTATIONS), the band's number mixed in."""
    grouped = least.reshape(len(least), PERMUTATIONS // ROWS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(grouped.shape[1], dtype=np.uint64) + np.uint64(1), grouped.shape[:2])
    for r in range(ROWS):
        key = mix(key + grouped[:, :, r])
    return key.view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """The lowest BITS bits of each minimum, 64 // BITS to a long."""
    per = 64 // BITS
    low = ((least ^ (least >> np.uint32(16))) & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(least), PERMUTATIONS // per, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=2).view(np.int64)


def most_unlike(threshold: float) -> int:
    """Largest number of unequal signature parts at which a pair is still confirmed."""
    chance = 2.0**-BITS
    share = chance + (1 - chance) * threshold
    return math.floor(PERMUTATIONS * (1 - share) + SIGMAS * math.sqrt(PERMUTATIONS * share * (1 - share)))


def unlike(a: Column, b: Column) -> Column:
    """Unequal parts of two packed signatures, by bit counts."""
    ones, total = sum(1 << i for i in range(0, 64, BITS)), None
    ones = ones - (1 << 64) if ones >> 63 else ones
    for i in range(PERMUTATIONS * BITS // 64):
        x = a[i].bitwiseXOR(b[i])
        s = 1
        while s < BITS:
            x = x.bitwiseOR(F.shiftrightunsigned(x, s))
            s *= 2
        n = F.bit_count(x.bitwiseAND(F.lit(ones)))
        total = n if total is None else total + n
    return total


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, text_hash, n_shingles, cls, bands, sig) of each row; cls is a 128-bit hash of the set; the last three null for an empty set."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for first, data, offsets in blocks(batch.column(1)):
                sets = shingle_sets(document_words(data, offsets), width)
                full = [s for s in sets if len(s)]
                least = np.stack([minima(s) for s in full]) if full else np.zeros((0, PERMUTATIONS), np.uint32)
                keys, sig, at = band_keys(least).tolist(), packed(least).tolist(), np.cumsum([len(s) > 0 for s in sets]) - 1
                pick = lambda rows: [rows[at[i]] if len(s) else None for i, s in enumerate(sets)]  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(sets)), batch.column(2).slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class(s) for s in sets], pa.binary()), pa.array(pick(keys), pa.list_(pa.int64())), pa.array(pick(sig), pa.list_(pa.int64()))],
                    ["id", "text_hash", "n_shingles", "cls", "bands", "sig"],
                )

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("text_hash")).mapInArrow(run, f"id {kind}, text_hash bigint, n_shingles bigint, cls binary, bands array<bigint>, sig array<bigint>")


def _class(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def full_sets(docs: DataFrame, id_col: str, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """(cls, shingles binary): the full set of each class in ``wanted`` (cls, first_id), made from its first document's text."""
    ids = wanted.select(F.col("first_id").alias("_first"))
    small = ids.count() <= BROADCAST_IDS
    ids = ids.distinct()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(ids) if small else ids, F.col("id").eqNullSafe(F.col("_first")), "left_semi")

    def run(batches):
        for batch in batches:
            for _, data, offsets in blocks(batch.column(0)):
                sets = [s for s in shingle_sets(document_words(data, offsets), width) if len(s)]
                yield pa.RecordBatch.from_pydict({"cls": pa.array([_class(s) for s in sets], pa.binary()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})

    made = rows.select("text").mapInArrow(run, "cls binary, shingles binary")
    return made.dropDuplicates(["cls"]).join(wanted.select("cls"), "cls", "left_semi")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes with 100 * intersection >= percent * union on their full sets."""

    def run(batches):
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                ok.append(share_enough(*(np.frombuffer(v.as_py(), np.uint64) for v in (a, b)), percent))
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a")
    both = one.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def share_enough(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct hashes."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def dealt_blocks(members: DataFrame) -> DataFrame:
    """(key, i, j, own, cls): the members (key, cls, label) of each bucket in every pair of blocks that may hold new links.

    Blocks of the bucket's largest label come after those of the others and are not paired with one another.
    """
    labels = members.groupBy("key", "label").agg(F.count("*").alias("size"))
    top = labels.groupBy("key").agg(F.max(F.struct("size", "label")).alias("top"), F.sum("size").alias("all"))
    blocks_of = lambda n: F.ceil(n / BLOCK).cast("int")
    some = top.select("key", F.col("top.label").alias("joined"), blocks_of(F.col("all") - F.col("top.size")).alias("u"), blocks_of(F.col("top.size")).alias("m")).where("u > 0")
    at = members.join(some, "key").withColumn("_in", F.col("label") == F.col("joined"))
    own = F.when(F.col("_in"), F.col("u") + F.pmod(F.xxhash64("cls"), F.col("m"))).otherwise(F.pmod(F.xxhash64("cls"), F.col("u"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("_in"), F.col("u")).otherwise(F.col("u") + F.col("m")) - 1))
    placed = at.select("key", "cls", own.alias("own"), other.alias("other"))
    return placed.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls")


def _passing(bucket: int, i: int, j: int, column: dict[str, pa.Array], percent: int, most: int):
    """Stretches of row pairs (p, q) of two blocks, or within one, that may be links between different labels."""
    ones, own, n = np.uint64(sum(1 << k for k in range(0, 64, BITS))), column["own"].to_numpy(), column["n"].to_numpy()
    sig = column["sig"].flatten().to_numpy().view(np.uint64).reshape(len(n), -1)
    bands = column["bands"].flatten().to_numpy().reshape(len(n), -1)
    names: dict[bytes, int] = {}
    label = np.array([names.setdefault(v, len(names)) for v in column["label"].to_pylist()])
    band = int(np.flatnonzero(bands[0] == bucket)[0])
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    for at in range(0, len(left), 32):
        part = left[at : at + 32]
        x = sig[part][:, None, :] ^ sig[right][None]
        s = 1
        while s < BITS:
            x |= x >> np.uint64(s)
            s *= 2
        ok = np.bitwise_count(x & ones).sum(2) <= most
        ok &= (n[part][:, None] * 100 >= n[right][None] * percent) & (n[right][None] * 100 >= n[part][:, None] * percent)
        ok &= label[part][:, None] != label[right][None]
        if i == j:
            ok &= part[:, None] < right[None]
        p, q = np.nonzero(ok)
        p, q = part[p], right[q]
        first = ~(bands[p, :band] == bands[q, :band]).any(1)
        yield p[first], q[first], label


def block_candidates(dealt: DataFrame, percent: int, most: int) -> DataFrame:
    """The rows (key, i, j, own, cls) of pairs of blocks that have a candidate there. ``dealt``: also n, label, sig, bands."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        column = {c: table[c].combine_chunks() for c in table.column_names}
        hit = np.zeros(table.num_rows, bool)
        for p, q, _ in _passing(*(k.as_py() for k in key), column, percent, most):
            hit[p] = hit[q] = True
        return table.select(["key", "i", "j", "own", "cls"]).filter(pa.array(hit))

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "key bigint, i int, j int, own int, cls binary")


def block_links(dealt: DataFrame, percent: int, most: int) -> DataFrame:
    """Links (a, b) between two blocks of a bucket, or within one, that join what was not joined before.

    ``dealt``: key, i, j, own and a member's cls, n, label, sig, bands, shingles; one group is a pair of blocks.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        column = {c: table[c].combine_chunks() for c in table.column_names}
        cls, sets = column["cls"].to_pylist(), [np.frombuffer(s, np.uint64) for s in column["shingles"].to_pylist()]
        root, out = list(range(len(cls))), []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for p, q, label in _passing(*(k.as_py() for k in key), column, percent, most):
            for a, b in zip(p.tolist(), q.tolist(), strict=True):
                one, two = find(label[a]), find(label[b])
                if one != two and share_enough(sets[a], sets[b], percent):
                    root[one] = two
                    out.append((cls[a], cls[b]))
        return pa.table({"a": pa.array([x[0] for x in out], pa.binary()), "b": pa.array([x[1] for x in out], pa.binary())})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = 5) -> DataFrame:
    """(id, n_shingles, component_id, kept, text_hash) of every document; text_hash tells rows of one id apart.

    Words are lower-cased (A-Z); a document's set holds its distinct runs of ``width`` words, or its whole
    sequence if it has fewer; without words or text it is empty and linked with nothing. Documents are linked
    from a similarity of ``percent`` / 100; component_id is the smallest id reachable. Repeated rows share a
    component; null ids are never the smallest, and kept compares null-safely. Result rows: one a document.
    """
    sketch = cut(sketches(docs, id_col, text_col, width), "sketch")
    classes = sketch.where("n_shingles > 0").groupBy("cls").agg(F.min("id").alias("first_id"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"))
    keyed = classes.select("cls", F.explode("bands").alias("key"))
    drawn = F.min(F.struct(F.xxhash64("cls", "key").alias("h"), "cls"))["cls"]
    shared = keyed.groupBy("key").agg(F.count("*").alias("m"), drawn.alias("center")).where("m > 1")
    members = cut(keyed.join(shared, "key"), "members")
    wanted = cut(classes.join(members.select("cls").distinct(), "cls", "left_semi"), "wanted")
    sets = cut(full_sets(docs, id_col, text_col, width, wanted), "sets")

    most = most_unlike(percent / 100)
    side = lambda x: wanted.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    near = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent) & (unlike(F.col("sig_a"), F.col("sig_b")) <= most)

    stars = members.where("cls <> center").select(F.least("center", "cls").alias("a"), F.greatest("center", "cls").alias("b")).distinct()
    stars = stars.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b")
    linked = cut(confirmed(stars, sets, percent), "stars")

    label = hop(linked)
    marked = cut(wanted.join(label, wanted["cls"] == label["node"], "left").select("cls", "n", "sig", "bands", F.coalesce("label", "cls").alias("label")), "marked")

    few = members.where(F.col("m") <= SMALL).select("cls", "key").join(marked.drop("bands"), "cls")
    left, right = (few.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("cls", "n", "sig", "label")]) for x in "ab")
    rest = left.join(right, "key").where((F.col("cls_a") < F.col("cls_b")) & (F.col("label_a") != F.col("label_b")) & near)
    rest = confirmed(rest.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct(), sets, percent)

    large = members.where(F.col("m") > SMALL).select("cls", "key").join(marked.select("cls", "label"), "cls")
    dealt = cut(dealt_blocks(large), "blocks")
    some = cut(block_candidates(dealt.join(marked, "cls"), percent, most), "candidates")
    links = cut(linked.union(rest).union(block_links(some.join(marked, "cls").join(sets, "cls"), percent, most)), "links")

    found = components(links)
    joined = classes.select("cls", "first_id").join(found, F.col("cls") == F.col("node"), "left").select("cls", "first_id", F.coalesce("label", "cls").alias("label"))
    linked_only = joined.join(found.select("label").distinct(), "label", "left_semi").groupBy("label").agg(F.min("first_id").alias("least"))
    named = joined.join(linked_only, "label", "left").select("cls", F.coalesce("least", "first_id").alias("component_id"))
    out = sketch.select("id", "n_shingles", "cls", "text_hash").join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "text_hash")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; all columns kept, whatever their names.

    Repeated rows count as copies. Rows of null ids stay once a text if their group has no id. Texts without
    words, null ones too, are linked with nothing, so each id keeps them. No documents give no rows.
    """
    found = near_duplicates(docs).where("kept")
    apart = F.when(F.col("doc_id").isNull(), F.col("text_hash"))
    chosen = found.groupBy("doc_id", "component_id", apart.alias("_apart")).agg(F.min("text_hash").alias("_hash")).select(F.col("doc_id").alias("_id"), "_hash").distinct()
    marked = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text_hash"))
    kept = marked.join(chosen, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_semi")
    return kept.dropDuplicates(["_doc", "_text_hash"]).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
