"""Figures of the README: python -m tessera.llm.measure recall ROWS [uniform|clustered|lognormal] | toxicity DIR | quality DIR | lm DIR"""

from __future__ import annotations

import sys

import numpy as np


def recall(n: int, kind: str = "uniform", queries: int = 40, k: int = 20, dim: int = 64) -> float:
    """Share of the k nearest that share a bucket with their query, by the operator's own hashes, without Spark."""
    from .ann import Hashes, band_of, functions_for, norms, probes_for

    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, dim))
    if kind == "clustered":
        x = rng.normal(size=(max(10, n // 200), dim))[rng.integers(0, max(10, n // 200), n)] + 0.5 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lognormal":
        x *= rng.lognormal(0, 0.5, (n, 1))
    top, functions = norms(x).max(), functions_for(n)
    h = Hashes(dim, np.unique(band_of(norms(x), top)).tolist(), top, functions)
    keys = np.concatenate([h.of_vectors(x[i : i + 5000]) for i in range(0, n, 5000)])
    scores = x[:queries] @ x.T
    scores[np.arange(queries), np.arange(queries)] = -np.inf
    near = np.argsort(-scores, 1)[:, :k]
    asked = h.of_queries(x[:queries], probes_for(functions), np.take_along_axis(scores, near[:, -1:], 1)[:, 0])
    return float(np.mean([[np.isin(keys[v], asked[q]).any() for v in near[q]] for q in range(queries)]))


def classifier(name: str, folder: str, least: float) -> dict[str, int]:
    """Held-out documents of each label, and how many of each are given label 1."""
    from pyspark.sql import functions as F

    from . import quality, toxicity

    spark, module = _spark(), {"toxicity": toxicity, "quality": quality}[name]
    docs = module.query(spark, folder).where("held_out")
    label = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("toxic" if name == "toxicity" else "quality").alias("y"))
    rows = docs.join(label, "doc_id").groupBy("y").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= least).alias("ones")).collect()
    return {f"label {r.y}": {"documents": r.n, "given 1": r.ones} for r in rows}


def language_model(folder: str) -> list[dict]:
    from pyspark.sql import functions as F

    from . import lm

    out = lm.query(_spark(), folder).groupBy("held_out").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), F.round(F.sum("base_score")).alias("base"), F.round(F.sum("score")).alias("score"), F.round(F.avg((F.col("score") > F.col("base_score")).cast("int")), 3).alias("over_base"))
    return [r.asDict() for r in out.collect()]


def _spark():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    what, *more = sys.argv[1:]
    if what == "recall":
        print(recall(int(more[0]), *more[1:]))
    elif what == "lm":
        print(language_model(more[0]))
    else:
        print(classifier(what, more[0], 0.5 if what == "toxicity" else 0.3))
