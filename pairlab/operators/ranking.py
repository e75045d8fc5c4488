"""Ranks and bins in an order over all rows, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hex_number
from ..plans.sequence import global_running, global_sequence


def percentile_ranks(df: DataFrame, value: str, name: str = "pct") -> DataFrame:
    """``df`` with the average-method percentile rank of ``value``: equal values share their mean rank, over the number of rows.

    Ranks come from counts of distinct values and range partitions; rows with a null value get null.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    run = global_running(counts, ["__v"], {"__before": "__n"})
    total = counts.agg(F.sum("__n").alias("__total"))
    pct = run.crossJoin(F.broadcast(total)).select("__v", ((F.col("__before") + (F.col("__n") + 1) / F.lit(2.0)) / F.col("__total")).alias(name))
    return df.join(pct, df[value] == pct["__v"], "left").drop("__v")


def tertile(pct: Column | str) -> Column:
    """early, middle or late by thirds of the percentile rank; the borders belong to the lower bin."""
    p = F.col(pct) if isinstance(pct, str) else pct
    return F.when(p <= F.lit(1.0) / 3, "early").when(p <= F.lit(2.0) / 3, "middle").when(p.isNotNull(), "late")


def first_appearance(df: DataFrame, keys: list[str], order: str, name: str = "index") -> DataFrame:
    """Distinct keys with their first ``order`` value and the number of their first appearance, from 0."""
    first = df.groupBy(*keys).agg(F.min(order).alias("first"))
    return global_sequence(first, ["first", *keys], name)


def half_assignment(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``key``, ``half``: exactly half of the distinct keys (rounded down) in half 1, by the order of a hash."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))))
    numbered = global_sequence(keys, ["__h", key], "__n")
    total = keys.agg(F.count("*").alias("__t"))
    return numbered.crossJoin(F.broadcast(total)).select(key, F.when(F.col("__n") < F.floor(F.col("__t") / 2), 1).otherwise(2).alias("half"))


def seeded_scores(df: DataFrame, id_col: str, seed: int, name: str = "score") -> DataFrame:
    """A number in [0, 1) for each id that depends on the id and the seed only."""
    return df.withColumn(name, hex_number(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))), 12) / F.lit(float(1 << 48)))
