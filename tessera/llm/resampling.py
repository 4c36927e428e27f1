"""Importance resampling towards a target distribution, over hashed n-grams.

Each Spark partition counts with DuckDB: SQL unnests the words, windows join them to n-grams, and a registered
function takes zlib's CRC-32 of each distinct n-gram. The bucket counts of each document are spilled to Parquet
in the shared folder; Spark merges them into those of the corpus and the target, and scores and ranks from them.

A null text has no words, an empty table gives an empty one, and repeated rows are documents each. A null id
counts as empty text where ids are hashed and comes first in ties. Columns besides id and text are not read.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that DuckDB counts at once, and the memory it may hold; a longer text is counted by itself.
SLICE, MEMORY = 8 << 20, "400MB"


def _crc32(grams):
    return pa.array([zlib.crc32(g) for chunk in grams.chunks for g in chunk.to_pylist()], pa.int64())


def count_sql(low: int, high: int, buckets: int) -> str:
    """Per row of ``slice`` (r, text): its words, its n-grams, and (bucket, n) of their hashes."""
    grams = ["SELECT r, word AS gram FROM w"] if low == 1 else []
    for k in range(max(low, 2), high + 1):
        ahead = f"OVER (PARTITION BY r ORDER BY place ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)"
        grams.append(f"SELECT r, gram FROM (SELECT r, string_agg(word, ' ') {ahead} AS gram, count(*) {ahead} AS k FROM w) WHERE k = {k}")
    place = ", generate_subscripts(words, 1) AS place" if high > 1 else ""
    return f"""
    WITH l AS (SELECT r, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM slice),
         w AS (SELECT r, unnest(words) AS word{place} FROM l),
         c AS (SELECT r, gram, count(*) AS n FROM ({" UNION ALL ".join(grams)}) GROUP BY r, gram),
         v AS (SELECT gram, crc32(encode(gram)) % {buckets} AS bucket FROM (SELECT DISTINCT gram FROM c)),
         b AS (SELECT r, bucket, sum(n)::BIGINT AS n FROM c JOIN v USING (gram) GROUP BY r, bucket),
         a AS (SELECT r, list(bucket::INTEGER) AS bucket, list(n) AS n, sum(n)::BIGINT AS total FROM b GROUP BY r)
    SELECT len(words)::BIGINT AS n_words, coalesce(total, 0) AS n_features, coalesce(bucket, []::INTEGER[]) AS bucket, coalesce(n, []::BIGINT[]) AS n
    FROM l LEFT JOIN a USING (r) ORDER BY r
    """


def slices(size: list[int]):
    """(first, number) of runs of rows of at most SLICE bytes, or of one row."""
    first = run = 0
    for i, n in enumerate(size):
        if i > first and run + n > SLICE:
            yield first, i - first
            first, run = i, 0
        run += n
    if len(size) > first:
        yield first, len(size) - first


def bucket_counts(docs: DataFrame, low: int, high: int, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, bucket list, n list) of each row; no shuffle."""
    sql, kinds = count_sql(low, high, buckets), [("n_words", pa.int64()), ("n_features", pa.int64()), ("bucket", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))]

    def run(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "preserve_insertion_order": False})
        con.create_function("crc32", _crc32, ["BLOB"], "BIGINT", type="arrow")
        for batch in batches:
            text = batch.column(1)
            for first, n in slices(pc.binary_length(text).to_pylist()):
                con.register("slice", pa.table({"r": pa.array(range(n), pa.int64()), "text": text.slice(first, n)}))
                found = con.sql(sql).to_arrow_table()
                con.unregister("slice")
                columns = [batch.column(0).slice(first, n), *(found[c].combine_chunks().cast(kind) for c, kind in kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["id", *(c for c, _ in kinds)])
        con.close()

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, bucket array<int>, n array<bigint>")


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket, from the counted rows of both: as many rows as buckets."""
    total = lambda rows, name: rows.select(F.explode(F.arrays_zip("bucket", "n")).alias("f")).groupBy(F.col("f.bucket").alias("bucket")).agg(F.sum("f.n").alias(name))
    each = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = cut(each.join(F.broadcast(total(docs, "s")), "bucket", "left").join(F.broadcast(total(target, "t")), "bucket", "left").na.fill(0), "buckets")
    whole = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    odds = (F.col("t") + F.lit(1.0)) * (F.col("all_s") + buckets) / ((F.col("s") + F.lit(1.0)) * (F.col("all_t") + buckets))
    return both.crossJoin(F.broadcast(whole)).select("bucket", F.floor(1000 * F.log(odds)).alias("gain"))


def scored(counts: DataFrame, gains: DataFrame, seed: int) -> DataFrame:
    """(id, n_words, n_features, weight, score) of counted rows: gains come by broadcast, and each row's sum is made before the shuffle."""
    rows = counts.withColumn("row", F.monotonically_increasing_id())
    each = rows.select("row", "id", "n_words", "n_features", F.explode_outer(F.arrays_zip("bucket", "n")).alias("f")).withColumn("bucket", F.col("f.bucket"))
    sums = each.join(F.broadcast(gains), "bucket", "left").groupBy("row", "id", "n_words", "n_features").agg(F.coalesce(F.sum(F.col("gain") * F.col("f.n")), F.lit(0)).alias("gained"))
    weight = F.expr("CASE WHEN n_features > 0 THEN (gained - pmod(gained, n_features)) DIV n_features ELSE 0 END")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return sums.select("id", "n_words", "n_features", weight.alias("weight"), (weight + noise).alias("score"))


def drawn(rows: DataFrame, min_words: int, percent: int) -> DataFrame:
    """``rows`` (a written table) with ``rank``: 1, 2, 3 ... for the floor(percent * N / 100) best of the N of at least ``min_words`` words.

    Scores are integers of a narrow range (within about 60,000 of each other), so a histogram of them gives
    every score its first rank; only rows of one score are sorted together, and equal rows are counted first.
    """
    able = F.col("n_words") >= min_words
    sizes = rows.where(able).groupBy("score").agg(F.count("*").alias("size"))
    up = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = sizes.withColumn("total", F.sum("size").over(whole)).select("score", (F.sum("size").over(up) - F.col("size")).alias("first"), F.expr(f"{percent} * total DIV 100").alias("most"))
    placed = rows.join(F.broadcast(first), "score", "left").withColumn("may", F.coalesce(able & (F.col("first") < F.col("most")), F.lit(False)))
    cols = rows.columns
    rest = placed.where(~F.col("may")).select(*cols, F.lit(None).cast("bigint").alias("rank"))
    counted = placed.where("may").groupBy(*cols, "first", "most").agg(F.count("*").alias("copies"))
    within = Window.partitionBy("score").orderBy("id", "n_words", "n_features", "weight").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("last", F.col("first") + F.sum("copies").over(within)).select(*cols, "most", F.explode(F.sequence(F.col("last") - F.col("copies") + 1, F.col("last"))).alias("rank"))
    return rest.unionByName(ranked.select(*cols, F.when(F.col("rank") <= F.col("most"), F.col("rank")).alias("rank")))


def resample(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000, seed: int = 2024, min_words: int = 20, percent: int = 10, id_col: str = "doc_id", target_id: str = "item_id") -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``docs``: weight is the mean gain of its n-grams of ``low`` to ``high`` words, rank null where it is not drawn."""
    counts, wanted = cut(bucket_counts(docs, low, high, buckets, id_col), "counts"), cut(bucket_counts(target, low, high, buckets, target_id), "target")
    rows = cut(scored(counts, bucket_gains(counts, wanted, buckets), seed), "scored")
    return drawn(rows, min_words, percent).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = rf"""
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
             lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
     d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
     c AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(words) AS word FROM d) GROUP BY ALL),
     m AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')) AS word FROM benchmark) GROUP BY ALL),
     x AS (SELECT word, list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda h: ('0x' || h)::BIGINT)) AS bytes FROM (SELECT word FROM c UNION SELECT word FROM m)),
     v AS (SELECT word, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT % 10000 AS bucket FROM x, tab),
     s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM c JOIN v USING (word) GROUP BY bucket),
     t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM m JOIN v USING (word) GROUP BY bucket),
     g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM s) + 10000) / ((s + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
     f AS (SELECT r, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS gained FROM c JOIN v USING (word) JOIN g USING (bucket) GROUP BY r),
     o AS (SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce((gained - ((gained % n) + n) % n) // n, 0)::BIGINT AS weight,
                  floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS noise FROM d LEFT JOIN f USING (r)),
     k AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id NULLS FIRST, n_features, weight) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank FROM k
"""
