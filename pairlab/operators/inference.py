"""Intervals, tail probabilities and corrections for several tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def percentile_interval(df: DataFrame, by: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """``by``, ``ci_lower``, ``ci_upper``, ``replicates``: interpolated percentiles over the finite values; null without any."""
    v = F.when(~F.isnan(value) & (F.abs(F.col(value)) != float("inf")), F.col(value))
    tail = (1 - level) / 2
    return df.groupBy(*by).agg(F.percentile(v, tail).alias("ci_lower"), F.percentile(v, 1 - tail).alias("ci_upper"), F.count(v).alias("replicates"))


def mean_std(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``by``, ``mean``, ``std`` (of a sample) over the values that aren't null."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def tail_p(df: DataFrame, by: Sequence[str], delta: str) -> DataFrame:
    """``by``, ``p_value``: two-sided, twice the smaller tail with one added to count and number, 1 at most."""
    d = F.col(delta)
    n = F.count(d) + 1.0
    return df.groupBy(*by).agg(F.least(F.lit(1.0), 2 * F.least((F.count_if(d <= 0) + 1) / n, (F.count_if(d >= 0) + 1) / n)).alias("p_value"))


def holm(df: DataFrame, family: Sequence[str], p: str, order: str, alpha: float = 0.05) -> DataFrame:
    """``df`` with ``p_adjusted`` and ``significant`` by Holm's step-down within each family; a null p stays null and isn't counted.

    A family is a list of tests (tens of them), so a window over it is small, with or without family columns.
    """
    named = df.withColumn("__f", F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in family]) if family else F.lit(""))
    valid = named.withColumn("__null", F.col(p).isNull())
    w = W.partitionBy("__f", "__null").orderBy(p, order)
    size = F.count("*").over(W.partitionBy("__f", "__null"))
    stepped = valid.withColumn("__s", (size - F.row_number().over(w) + 1) * F.col(p))
    adjusted = F.least(F.lit(1.0), F.max("__s").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return stepped.withColumn("p_adjusted", F.when(~F.col("__null"), adjusted)).withColumn("significant", F.col("p_adjusted") < alpha).drop("__f", "__null", "__s")


def contrasts(values: DataFrame, keys: Sequence[str], system: str, pairs: DataFrame, value: str = "value") -> DataFrame:
    """``keys``, ``first``, ``second``, ``delta``: value of ``second`` less value of ``first``, for each pair listed."""
    a = values.select(*keys, F.col(system).alias("first"), F.col(value).alias("__a"))
    b = values.select(*keys, F.col(system).alias("second"), F.col(value).alias("__b"))
    return a.join(F.broadcast(pairs.select("first", "second")), "first").join(b, [*keys, "second"]).select(*keys, "first", "second", (F.col("__b") - F.col("__a")).alias("delta"))
