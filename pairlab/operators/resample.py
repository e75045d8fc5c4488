"""Bootstrap over queries by weights: a relation (replicate, query, w) joined to rows turns every metric into a weighted one."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hex_number
from ..plans.sequence import global_sequence, running


def numbered_queries(df: DataFrame, query: str, within: str | None = None) -> DataFrame:
    """Distinct queries (of each ``within`` group) numbered from 0 by name, with the group's number of queries ``n``."""
    if within is None:
        q = df.select(query).where(F.col(query).isNotNull()).distinct()
        return global_sequence(q, [query], "i").crossJoin(F.broadcast(q.agg(F.count("*").alias("n"))))
    q = df.select(within, query).where(F.col(query).isNotNull()).distinct()
    return running(q, [within], [query], {"i": None}).join(q.groupBy(within).agg(F.count("*").alias("n")), within)


def weights(queries: DataFrame, query: str, replicates: int, seed: int, within: str | None = None) -> DataFrame:
    """``replicate``, ``query``, ``w`` > 0 (and ``within``): n draws of n with replacement for each replicate.

    Draw j of replicate b takes the query whose number is a hash of (seed, b, j) modulo n, so the same draw is
    shared by all systems. With ``within``, groups draw independently, their name being part of the hash.
    """
    keys = [within] if within else []
    reps = queries.sparkSession.range(replicates).select(F.col("id").cast("int").alias("replicate"))
    parts = [F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("replicate").cast("string"), F.col("i").cast("string")]
    # Every numbered query stands for one draw of each replicate: n x replicates rows, the size of the result.
    draws = queries.crossJoin(F.broadcast(reps)).select(*keys, "replicate", (hex_number(F.md5(F.concat_ws("|", *parts)), 12) % F.col("n")).alias("i"))
    drawn = draws.groupBy(*keys, "replicate", "i").agg(F.count("*").alias("w"))
    return drawn.join(queries.select(*keys, "i", query), [*keys, "i"]).select(*keys, "replicate", query, "w")


def numpy_weights(spark, queries: Sequence[str], query: str, replicates: int, seed: int) -> DataFrame:
    """The same relation from one NumPy generator on the driver, for published draws; sized by replicates x queries."""
    rng, n = np.random.default_rng(seed), len(queries)
    rows = []
    for b in range(replicates):
        at, w = np.unique(rng.integers(0, n, n), return_counts=True)
        rows += [(b, queries[i], int(c)) for i, c in zip(at, w)]
    return spark.createDataFrame(rows, f"replicate int, {query} string, w long")


def resampled(df: DataFrame, w: DataFrame, query: str, within: str | None = None) -> DataFrame:
    """Rows of the drawn queries in each replicate with their weight ``w``."""
    return df.join(w, [*([within] if within else []), query])
