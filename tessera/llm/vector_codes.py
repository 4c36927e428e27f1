"""Vector code compression: product codes from weighted Lloyd rounds over distinct integer parts.

Vectors become integers and are cut into parts. Equal parts of a position are counted into distinct rows with a
weight; every round runs over these only: tasks assign them to the nearest entries of a codebook of a fixed
size and emit a sum per entry, Spark merges the sums, and the driver divides them. Codes and errors of
distinct parts are then joined back to the vectors.

Vectors that are null or hold a null or non-finite component are dropped. Vectors shorter than the longest
one count as padded with zeros, as does a length that the parts don't divide. Repeated rows count and are coded each;
of rows that share one of the smallest ids the smallest vector seeds an entry. Null ids come last. With
fewer ids than entries there are fewer entries; an empty table gives an empty one. Components beyond 64 bits
count as the nearest 64-bit integer, errors beyond as the largest one. Columns besides the three are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut

MOST = (1 << 63) - 1
#: A key with this share of all rows is joined by broadcast: at most so many keys can have it.
HOT = 1000


def integer_rows(table: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int, scale: int) -> DataFrame:
    """(row, id, label, vector): kept rows as integers, padded to one length, written once."""
    v = F.col("vector")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).where(fine)
    length = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    length = max(parts, -(-length // parts) * parts)
    whole = F.transform("vector", lambda x: F.floor(F.least(F.greatest(scale * x, F.lit(-(2.0**63))), F.lit(2.0**63 - 1024))))
    padded = F.concat(whole, F.array_repeat(F.lit(0).cast("bigint"), F.lit(length) - F.size(v)))
    return cut(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", padded.alias("vector")), "vectors")


def seeds(rows: DataFrame, entries: int) -> list[list[int]]:
    """The vectors of the smallest ids, ascending."""
    best = rows.groupBy("id").agg(F.min("vector").alias("vector")).orderBy(F.asc_nulls_last("id")).limit(entries)
    return [r["vector"] for r in best.collect()]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of ``x``, ties to the lower index, and its squared distance, in exact integers."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)), *(abs(int(a.min(initial=0))) for a in (x, book)))
    if 4 * top * top * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), book.astype(np.float64)
        d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]
    else:
        a, b = x.astype(object), book.astype(object)
        d = np.stack([((a - e) ** 2).sum(1) for e in b], 1)
    at = d.argmin(1) if d.dtype != object else np.array([min(range(len(b)), key=row.__getitem__) for row in d], np.int64).reshape(len(x))
    return at, np.minimum(d[np.arange(len(x)), at], MOST).astype(np.int64) if d.dtype == object else d[np.arange(len(x)), at].astype(np.int64)


def _by_part(batch: pa.RecordBatch):
    """(part, its rows' places, their values) of a batch of distinct parts."""
    part = batch.column(0).to_numpy()
    values = batch.column(1).flatten().to_numpy().reshape(len(part), -1)
    for p in np.unique(part):
        at = np.flatnonzero(part == p)
        yield int(p), at, values[at]


def lloyd_round(distinct: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: entries are the floored means of their parts, unused ones stay."""
    shipped = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        sums: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            weight = batch.column(2).to_numpy()
            for p, rows, x in _by_part(batch):
                at, _ = nearest(x, shipped.value[p])
                w = weight[rows]
                safe = int(np.abs(x).max(initial=0)) * int(w.sum()) < 1 << 62 and x.min(initial=0) > -MOST
                for e in np.unique(at):
                    mine = at == e
                    total = (x[mine] * w[mine, None]).sum(0) if safe else (x[mine].astype(object) * w[mine, None].astype(object)).sum(0)
                    for j, v in enumerate([int(w[mine].sum()), *map(int, total)]):
                        sums[p, int(e), j] = sums.get((p, int(e), j), 0) + v
        if sums:
            columns = [pa.array([k[i] for k in sums], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([str(v) for v in sums.values()])], ["part", "entry", "place", "total"])

    found = distinct.mapInArrow(run, "part int, entry int, place int, total string")
    merged = {(r["part"], r["entry"], r["place"]): int(r["total"]) for r in found.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    out = [book.copy() for book in books]
    for (p, e, j), total in merged.items():
        if j:
            out[p][e, j - 1] = total // merged[p, e, 0]
    return out


def coded(distinct: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(part, piece, n, entry, error) of each distinct part."""
    shipped = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            entry, error = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int64)
            for p, rows, x in _by_part(batch):
                entry[rows], error[rows] = nearest(x, shipped.value[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(entry), pa.array(error)], ["part", "piece", "n", "entry", "error"])

    return distinct.mapInArrow(run, "part int, piece array<bigint>, n bigint, entry int, error bigint")


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` joined on ``keys`` (nulls equal) with ``counted``: one row a key, ``n`` the number of ``rows`` that have it, of ``total`` in all.

    Keys with at least one in HOT of all rows, so at most HOT of them, come by broadcast and are not shuffled;
    the shuffled rest has no large key.
    """
    names = [f"_{k}" for k in keys]
    right = counted.withColumnsRenamed(dict(zip(keys, names, strict=True)))
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    hot = F.col("n") * HOT >= F.lit(total)
    few = F.broadcast(right.where(hot))
    large = rows.join(few, on, "inner")
    rest = rows.join(few.select(*names), on, "left_anti").join(right.where(~hot), on, "inner")
    return large.unionByName(rest).drop(*names, "n")


def error_sum(name: str):
    return F.coalesce(F.try_sum(name), F.lit(MOST))


def compress(table: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[list[list[int]]]]:
    """(id, label, code, error) of each kept row, and the codebooks by part and entry; ``code`` has two hex digits a part, ``entries`` at most 256."""
    rows = integer_rows(table, id_col, vector_col, label_col, parts, scale)
    found = seeds(rows, entries)
    size = len(found[0]) // parts if found else 1
    piece = lambda p: F.slice("vector", p * size + 1, size)
    pieces = F.posexplode(F.array(*[piece(p) for p in range(parts)]))
    distinct = rows.select(pieces.alias("part", "piece")).groupBy("part", "piece").agg(F.count("*").alias("n"))
    distinct = cut(distinct, "parts")
    books = [np.array([v[p * size : (p + 1) * size] for v in found], np.int64).reshape(len(found), size) for p in range(parts)]
    for _ in range(rounds if found else 0):
        books = lloyd_round(distinct, books)
    codes = cut(coded(distinct, books), "codes")
    each = rows.select("row", "id", "label", pieces.alias("part", "piece"))
    total = rows.count()
    joined = join_counted(each, codes, ["part", "piece"], total)
    hexes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "entry"))), lambda x: F.lower(F.lpad(F.hex(x["entry"]), 2, "0"))), "")
    out = joined.groupBy("row", "id", "label").agg(hexes.alias("code"), error_sum("error").alias("error"))
    return cut(out.select("id", "label", "code", "error"), "coded"), [b.tolist() for b in books]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    by_label = rows.groupBy("label").agg(F.count("*").alias("n"), error_sum("error").alias("label_error"))
    out = join_counted(rows, by_label, ["label"], rows.count())
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """DuckDB SQL of the same rows, for vectors of one length."""
    distance = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    assigned = lambda k: f"n{k} AS MATERIALIZED (SELECT r, p, any_value(v) AS v, min({distance} * {entries} + e) AS m FROM x JOIN b{k} USING (p) GROUP BY r, p)"
    steps = []
    for k in range(rounds):
        steps.append(assigned(k))
        steps.append(f"s{k} AS (SELECT p, m % {entries} AS e, j, sum(v[j + 1])::BIGINT AS s, count(*) AS n FROM n{k}, range(len(v)) t(j) GROUP BY ALL)")
        steps.append(f"u{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM s{k} GROUP BY p, e)")
        steps.append(f"b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(u{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN u{k} USING (p, e))")
    steps.append(assigned(rounds))
    return f"""
    WITH k AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda f: floor(4096 * f::DOUBLE)::BIGINT) AS w FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda f: f IS NULL OR NOT isfinite(f))) = 0),
         x AS MATERIALIZED (SELECT r, p, w[p * (len(w) // {parts}) + 1 : (p + 1) * (len(w) // {parts})] AS v FROM k, range({parts}) t(p)),
         i AS (SELECT arg_min(r, w) AS r, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS e FROM k GROUP BY vec_id),
         b0 AS (SELECT p, e, v AS c FROM x JOIN i USING (r) WHERE e < {entries}),
         {", ".join(steps)},
         h AS (SELECT sha256(string_agg(z, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(c, ',') AS z FROM b{rounds})),
         o AS (SELECT r, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM n{rounds} GROUP BY r)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN o USING (r), h
    """
