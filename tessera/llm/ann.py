"""Approximate nearest neighbours by multiprobe p-stable hashing.

A vector's bucket in a table is the vector of floor((a.x + b) / width) for random Gaussian a, as many as keep
buckets at a few vectors each. Of a query's table the buckets likeliest to hold a near vector are visited:
stepping to a neighbouring value of a function costs the squared distance to that boundary, and perturbations
are taken in order of total cost, the query's own bucket first. All tables' candidates are merged and ranked
by exact inner product. Inner products become distances by one more coordinate, sqrt(1 - |x|^2 / R^2), which is
0 for queries. R is the largest norm of a band of vectors whose norms differ by less than BAND, so that one
long vector does not press the others together; a query probes every band that could still hold one of its k
nearest, which a band can't if |q| times R is below the k-th score so far.

Buckets of all tables are dealt over cells by their hash. A vector goes to a cell once, with its buckets
there, and a query with its probes there; cells over CELL rows, as of one common vector, are split by id, and
so are the queries of a cell. In a cell each bucket is one matrix product of its vectors and its queries, and
what leaves the cell is the best k of each query, so no candidate pair becomes a row. A first pass over the
queries' own buckets alone finds for each the k-th best so far; the pass over all probes then gives only what
is as good. Queries that find fewer than k, as in small tables, are ranked against all rows in blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut
from .textkernels import mix

TABLES, WIDTH = 12, 2.0
#: Functions and probes of a table at BASE vectors; each doubling of the vectors takes one more function and GROWTH times the probes.
BASE, FUNCTIONS, PROBES, GROWTH = 50_000, 10, 260, 1.75
LEAST_FUNCTIONS, MOST_FUNCTIONS = 3, 14
#: Norms of a band differ by less than this factor; the last of BANDS holds all that are shorter.
BAND, BANDS = 1.25, 32
#: Rows of a cell, and queries of a cell, that one task takes; pairs that a task holds before it ranks them.
CELL, QUERIES, HELD = 65_536, 8_192, 1 << 20


def functions_for(n: int) -> int:
    return min(MOST_FUNCTIONS, max(LEAST_FUNCTIONS, round(FUNCTIONS + math.log2(max(n, 1) / BASE))))


def probes_for(functions: int) -> int:
    return max(9, min(3**functions, round(PROBES * GROWTH ** (functions - FUNCTIONS))))


@dataclass
class Hashes:
    dim: int
    bands: list[int]  # those that have vectors
    top: float  # the largest norm of all
    functions: int = FUNCTIONS
    tables: int = TABLES
    width: float = WIDTH
    seed: int = 20

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.turn = rng.normal(size=(self.tables, self.dim + 1, self.functions))
        self.shift = rng.uniform(0, self.width, (self.tables, self.functions))

    def places(self, x: np.ndarray) -> np.ndarray:
        """Real-valued buckets, tables x vectors x functions, of unit vectors with one more coordinate."""
        return (np.einsum("nd,tdf->tnf", x, self.turn, optimize=True) + self.shift[:, None]) / self.width

    def keys(self, buckets: np.ndarray, table: int) -> np.ndarray:
        """64-bit keys of buckets, given along the last axis, before the band is mixed in."""
        h = np.full(buckets.shape[:-1], table + 1, np.uint64)
        for f in range(self.functions):
            h = mix(h + buckets[..., f].astype(np.int64).view(np.uint64))
        return h

    def of_vectors(self, x: np.ndarray) -> np.ndarray:
        """The key of each vector in each table."""
        size = norms(x)
        band = band_of(size, self.top)
        scaled = x / longest(band, self.top)[:, None]
        real = self.places(np.concatenate([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1, keepdims=True)))], 1))
        keys = np.stack([self.keys(np.floor(real[t]), t) for t in range(self.tables)], 1)
        return mix(keys + band[:, None].astype(np.uint64))

    def of_queries(self, x: np.ndarray, probes: int, least: np.ndarray) -> list[np.ndarray]:
        """The keys that each query visits: ``probes`` a table in every band that may hold a product of ``least`` or more."""
        size = norms(x)
        real = self.places(np.concatenate([x / size[:, None], np.zeros((len(x), 1))], 1))
        base = np.floor(real)
        keys = np.concatenate([self.keys(base[t][:, None, :] + perturbations(real[t] - base[t], probes), t) for t in range(self.tables)], 1)
        out = []
        for i in range(len(x)):
            some = np.array(self.bands)
            some = some[size[i] * longest(some, self.top) >= least[i]].astype(np.uint64)
            out.append(np.unique(mix(keys[i][None] + some[:, None])))
        return out


def norms(x: np.ndarray) -> np.ndarray:
    """Euclidean norms, also of numbers whose squares would be 0 or infinite."""
    most = np.abs(x).max(1)
    return most * np.linalg.norm(x / most[:, None], axis=1)


def band_of(size: np.ndarray, top: float) -> np.ndarray:
    return np.clip(np.floor(np.log(top / size) / np.log(BAND) + 1e-9), 0, BANDS - 1).astype(np.int64)


def longest(band: np.ndarray, top: float) -> np.ndarray:
    """What no norm of a band is over."""
    return top * BAND ** (-1.0 * band) * (1 + 1e-6)


def perturbations(rest: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` cheapest steps (-1, 0 or 1 a function) for each row of distances to the lower boundary, cheapest first."""
    n = len(rest)
    cost, steps = np.zeros((n, 1)), np.zeros((n, 1, 0), np.int64)
    for f in range(rest.shape[1]):
        own = np.stack([np.zeros(n), rest[:, f] ** 2, (1 - rest[:, f]) ** 2], 1)
        total = (cost[:, :, None] + own[:, None, :]).reshape(n, -1)
        best = np.argsort(total, 1)[:, :probes]
        cost = np.take_along_axis(total, best, 1)
        steps = np.concatenate([np.take_along_axis(steps, best[:, :, None] // 3, 1), np.array([0, -1, 1])[best % 3][:, :, None]], 2)
    return steps


def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their vectors: of ``dim`` finite components, not all 0."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    x = column.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    ok = np.isfinite(x).all(1) & x.any(1)
    return rows[ok], x[ok]


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values that lie end to end in ``data``, of so many items each."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def dealt(vectors: DataFrame, hashes: Hashes, cells: int, probes: int | None, kept: str) -> DataFrame:
    """(cell, id, vec, keys, least) of ``vectors`` (_id, _v, _least): each once a cell with its keys there; queries if ``probes`` is set.

    ``kept``: the vectors' numpy type.
    """
    shipped = vectors.sparkSession.sparkContext.broadcast(hashes)

    def run(batches):
        h = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ok, x = _vectors(part.column(1), h.dim)
                if not len(ok):
                    continue
                least = part.column(2).to_numpy()[ok]
                every = list(h.of_vectors(x)) if probes is None else h.of_queries(x, probes, least)
                keys, who = np.concatenate(every), np.repeat(np.arange(len(x)), [len(k) for k in every])
                home = ((keys >> np.uint64(20)) % np.uint64(cells)).astype(np.int64)
                order = np.lexsort((keys, home, who))
                keys, who, home = keys[order], who[order], home[order]
                first = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (home[1:] != home[:-1])]))
                rows = who[first]
                ids = part.column(0).take(pa.array(ok[rows]))
                vec = _binary(x[rows].astype(kept).ravel(), np.full(len(rows), h.dim))
                yield pa.RecordBatch.from_arrays([pa.array(home[first]), ids, vec, _binary(keys, np.diff(np.append(first, len(keys)))), pa.array(least[rows])], ["cell", "id", "vec", "keys", "least"])

    return vectors.select("_id", "_v", "_least").mapInArrow(run, "cell bigint, id bigint, vec binary, keys binary, least double")


def measured(vectors: DataFrame, dim: int) -> DataFrame:
    """(_id, size): the norms of the vectors that take part."""

    def run(batches):
        for batch in batches:
            ok, x = _vectors(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), pa.array(norms(x) if len(x) else np.zeros(0))], ["_id", "size"])

    return vectors.select("_id", "_v").mapInArrow(run, "_id bigint, size double")


def banded(sized: DataFrame, top: float) -> DataFrame:
    """(band) of each norm, by the same sums that deal the vectors out."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(band_of(batch.column(0).to_numpy(), top)), pa.int64())], ["band"])

    return sized.select("size").mapInArrow(run, "band bigint")


class Best:
    """The k best (query row, vector row) pairs of each query, no worse than its ``least``, found block by block."""

    def __init__(self, table: dict[str, np.ndarray], query: dict[str, np.ndarray], k: int):
        self.table, self.query, self.k, self.least = table, query, k, query["least"].copy()
        self.found, self.held, self.limit = [], 0, HELD

    def block(self, rows: np.ndarray, asked: np.ndarray) -> None:
        """Merge the products of some vectors with some queries."""
        rough = self.table["vec"][rows] @ self.query["vec"][asked].T
        slack = 1e-12 * self.query["reach"][asked]  # of sums in another order
        good = (rough >= self.least[asked] - slack) & (self.table["id"][rows][:, None] != self.query["id"][asked][None])
        r, q = np.nonzero(good)
        self.found.append((asked[q], rows[r]))
        self.held += len(r)
        if self.held > self.limit:
            self.ranked()
            self.limit = HELD + 2 * self.held

    def ranked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query rows, vector rows, exact scores) of what is best so far; ties go to the smaller id."""
        q, r = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*self.found, strict=True)) if self.found else (np.zeros(0, np.int64),) * 2
        pair = np.unique(q * len(self.table["id"]) + r)
        q, r = pair // max(1, len(self.table["id"])), pair % max(1, len(self.table["id"]))
        exact = np.concatenate([np.zeros(0), *[(self.table["vec"][r[i : i + 65_536]] * self.query["vec"][q[i : i + 65_536]]).sum(1) for i in range(0, len(r), 65_536)]])
        order = np.lexsort((self.table["id"][r], -exact, q))
        q, r, exact = q[order], r[order], exact[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], exact[last])
        stay = (place < self.k) & (exact >= self.least[q])
        self.found, self.held = [(q[stay], r[stay])], int(stay.sum())
        return q[stay], r[stay], exact[stay]


def best_of(table: dict[str, np.ndarray], query: dict[str, np.ndarray], k: int, every: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query: those that share a key with it, or ``every`` row."""
    best = Best(table, query | {"reach": norms(query["vec"]) * norms(table["vec"]).max()}, k)
    if every:
        for i in range(0, len(table["id"]), 4096):
            for j in range(0, len(query["id"]), 512):
                best.block(np.arange(i, min(i + 4096, len(table["id"]))), np.arange(j, min(j + 512, len(query["id"]))))
        return best.ranked()
    flat = []
    for side in (table, query):
        keys, owner = np.concatenate(side["keys"]), np.repeat(np.arange(len(side["id"])), [len(v) for v in side["keys"]])
        order = np.argsort(keys, kind="stable")
        found, first = np.unique(keys[order], return_index=True)
        flat.append((found, np.append(first, len(keys)), owner[order]))
    (a, a_at, a_owner), (b, b_at, b_owner) = flat
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    for lo, hi, p, q in zip(a_at[i].tolist(), a_at[i + 1].tolist(), b_at[j].tolist(), b_at[j + 1].tolist(), strict=True):
        best.block(a_owner[lo:hi], b_owner[p:q])
    return best.ranked()


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", probes: int | None = None, **options) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each query row, its own id left out.

    Ties go to the smaller id; ids are integers. Vectors that are null, zero, of another length than most (of
    lengths as frequent the smallest), or that hold nulls or numbers that are not finite, take no part; nor do
    null ids. Rows that repeat an id and its vector count once, and of differing vectors of one id the nearest. A query has k
    rows, or one for each other id if there are fewer. No vectors give no rows; other columns are dropped.
    """
    spark = vectors.sparkSession
    usable = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("_id"), F.col(vec_col).cast("array<double>").alias("_v"), is_query.alias("_q"), F.lit(float("-inf")).alias("_least"))
    finite = F.forall("_v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    lengths = usable.where(finite & F.exists("_v", lambda v: v != 0)).groupBy(F.size("_v").alias("dim")).count()
    dim = lengths.orderBy(F.desc("count"), "dim").first()
    out = "query_id bigint, vec_id bigint, score double"
    if not dim:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sized = cut(measured(usable, dim["dim"]), "norms")
    n, ids, top = sized.agg(F.count("*"), F.count_distinct("_id"), F.max("size")).first()
    bands = [r["band"] for r in banded(sized, top).distinct().collect()]  # at most BANDS
    hashes = Hashes(dim["dim"], sorted(bands), top, options.pop("functions", functions_for(n)), **options)
    probes, wanted = probes or probes_for(hashes.functions), min(k, ids - 1)
    cells = max(1, -(-hashes.tables * n // (2 * CELL)))
    kept = "<f4" if dict(vectors.dtypes)[vec_col] == "array<float>" else "<f8"
    index = cut(dealt(usable, hashes, cells, None, kept).drop("least"), "index")
    sizes = index.groupBy("cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias("g"))

    def runner(every: bool):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not (left.num_rows and right.num_rows):
                return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            a, b = ({"id": t["id"].to_numpy(), "vec": np.stack([np.frombuffer(v, kept) for v in t["vec"].to_pylist()]).astype(np.float64), "keys": [np.frombuffer(v, np.uint64) for v in t["keys"].to_pylist()]} for t in (left, right))
            q, r, score = best_of(a, b | {"least": right["least"].to_numpy()}, k, every)
            return pa.table({"query_id": b["id"][q], "vec_id": a["id"][r], "score": score})

        return run

    def search(table: DataFrame, sizes: DataFrame, asked: DataFrame, every: bool = False) -> DataFrame:
        """The best of every cell of ``table`` for the queries dealt over them (cell, id, vec, keys, least)."""
        parts = sizes.join(asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("h")), "cell")

        def spread(rows: DataFrame, own: str, other: str, *more: str) -> DataFrame:
            mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(f"_{own}")
            return rows.join(parts, "cell").select("cell", "id", "vec", "keys", *more, mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"_{other}"))

        keys = ["cell", "_g", "_h"]
        found = spread(table, "g", "h").groupBy(*keys).cogroup(spread(asked, "h", "g", "least").groupBy(*keys)).applyInArrow(runner(every), out)
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    queries = usable.where("_q")
    own = cut(dealt(queries, hashes, cells, 1, kept), "own")
    first = search(index, sizes, own)
    bounds = first.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select(F.col("query_id").alias("_id"), F.col("score").alias("bound"))
    asked = queries.join(bounds, "_id", "left").select("_id", "_v", F.coalesce("bound", "_least").alias("_least"))
    some = search(index, sizes, cut(dealt(asked, hashes, cells, probes, kept), "asked")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ranked = cut(some.select("query_id", "rank", "vec_id", "score"), "ranked")

    full = ranked.where(F.col("rank") == wanted).select(F.col("query_id").alias("id"))
    short = cut(own.join(full, "id", "left_anti").dropDuplicates(["id", "vec"]).withColumns({"keys": F.lit(b""), "least": F.lit(float("-inf"))}), "short")
    if not wanted or short.isEmpty():
        return ranked
    g = max(1, -(-n // CELL))
    blocks = dealt(usable, Hashes(hashes.dim, hashes.bands, top, 1, 1), 1, None, kept).withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(g)))
    blocks = cut(blocks.select("cell", "id", "vec", F.lit(b"").alias("keys")), "blocks")
    rest = cut(short.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(g - 1).cast("bigint")))), "rest")
    whole = search(blocks, blocks.groupBy("cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias("g")), rest, True)
    whole = whole.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return ranked.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").union(whole)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
