"""Dense vectors: similarity, nearest neighbours, ties."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.sequence import running


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product in DOUBLE; null where a vector is null or their lengths differ."""
    a, b = _c(a), _c(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine; null for zero vectors."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(a: Column | str) -> Column:
    """The vector divided by its length; null for a zero vector."""
    n = F.nullif(norm(a), F.lit(0.0))
    return F.transform(_c(a), lambda x: x.cast("double") / n)


def best_by_query(scores: DataFrame, query: str, candidate: str, score: str) -> DataFrame:
    """``query``, ``candidate``, ``score`` of the best candidate; the least candidate on ties. One map-side combined aggregation."""
    best = scores.groupBy(query).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(candidate)).alias("c"))).alias("b"))
    return best.select(query, (-F.col("b.c")).alias(candidate), F.col("b.s").alias(score))


def strict_rank(scores: DataFrame, query: str, score: str, name: str = "rank") -> DataFrame:
    """1 + the number of the query's rows with a larger score; rows without a score are left out."""
    counts = scores.where(F.col(score).isNotNull()).groupBy(query, score).agg(F.count("*").alias("__n"))
    ranks = running(counts, [query], [(score, "desc")], {name: "__n"}).select(query, score, (F.col(name) + 1).alias(name))
    return scores.join(ranks, [query, score])


def count_best(scores: DataFrame, query: str, score: str, atol: float = 1e-8) -> DataFrame:
    """``query``, ``ties``: rows within ``atol`` of the best score."""
    best = scores.groupBy(query).agg(F.max(score).alias("__b"))
    return scores.join(best, query).groupBy(query).agg(F.count_if(F.abs(F.col("__b") - F.col(score)) <= atol).alias("ties"))


def nearest(queries: DataFrame, query_id: str, query_vector: str, corpus: DataFrame, corpus_id: str, vector: str, block: int = 2048, within: str | None = None, digits: int = 9) -> DataFrame:
    """``query_id``, ``corpus_id``, ``similarity``: the most similar row of the corpus for each query row (not itself), the least id on ties.

    Exact; similarities are compared after rounding to ``digits``. With ``within``, a column of both tables, only rows with the same value
    count (a null has none). The stated query set is taken in blocks of ``block`` rows, gathered one block at a time
    as a matrix; each block is one scan of the corpus, whose tasks return one best row for each query.
    Null and zero vectors are left out.
    """
    spark = queries.sparkSession
    kind = dict(corpus.dtypes)[corpus_id]
    group = lambda: (F.col(within) if within else F.lit(0)).cast("string").alias("g")
    rows = corpus.select(F.col(corpus_id).alias("c"), F.col(vector).alias("v"), group()).where("c is not null and v is not null and g is not null")
    stated = queries.select(F.col(query_id).alias("q"), F.col(query_vector).alias("v"), group()).where("q is not null and v is not null and g is not null")
    blocks = max(1, -(-stated.count() // block))
    numbered = stated.withColumn("b", F.pmod(F.xxhash64("q"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        part = numbered.where(F.col("b") == b).toPandas()
        if not len(part):
            continue
        ids, of, matrix = part["q"].to_numpy(), part["g"].to_numpy(), np.array(part["v"].tolist(), dtype=np.float64)
        size = np.linalg.norm(matrix, axis=1)
        ids, of, matrix = ids[size > 0], of[size > 0], matrix[size > 0] / size[size > 0, None]
        shared = spark.sparkContext.broadcast((ids, of, matrix))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, of, matrix = shared.value
            best, who = np.full(len(ids), -np.inf), None
            for b in batches:
                c, g = b["c"].to_numpy(), b["g"].to_numpy()
                m = np.array(b["v"].tolist(), dtype=np.float64)
                n = np.linalg.norm(m, axis=1)
                c, g, m = c[n > 0], g[n > 0], m[n > 0] / n[n > 0, None]
                if not len(c):
                    continue
                order = np.argsort(c, kind="stable")
                c, g, m = c[order], g[order], m[order]
                s = np.round(matrix @ m.T, digits)
                s[(ids[:, None] == c[None, :]) | (of[:, None] != g[None, :])] = -np.inf
                top = s.argmax(axis=1)
                v, w = s[np.arange(len(ids)), top], c[top]
                who = w if who is None else who
                better = (v > best) | ((v == best) & (w < who))
                best, who = np.where(better, v, best), np.where(better, w, who)
            keep = np.isfinite(best)
            if keep.any():
                yield pd.DataFrame({"q": ids[keep], "c": who[keep], "s": best[keep]})

        found = rows.mapInPandas(scan, f"q {dict(stated.dtypes)['q']}, c {kind}, s double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return stated.select(F.col("q").alias("query_id"), F.lit(None).cast(kind).alias("corpus_id"), F.lit(None).cast("double").alias("similarity")).limit(0)
    ranked = out.groupBy("q").agg(F.max("s").alias("s"), F.min_by("c", F.struct(-F.col("s"), F.col("c"))).alias("c"))
    return ranked.select(F.col("q").alias("query_id"), F.col("c").alias("corpus_id"), F.col("s").alias("similarity"))
