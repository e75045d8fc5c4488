"""Dates of queries, chronological bins and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_since
from .audits import one_anchor
from .ranking import percentile_ranks, tertile


def query_table(df: DataFrame, query: str, wanted: Column, day: str, anchor: str, strict: bool = True) -> DataFrame:
    """``query``, ``day``, ``rows``, ``days``: queries with a wanted row, which dates them, and the days since ``anchor``.

    Queries without one are left out. A query with several is an error if ``strict`` (an action), else the first date counts."""
    out = one_anchor(df, query, wanted, [day])
    if strict:
        bad = out.where("several").count()
        if bad:
            raise ValueError(f"{bad} queries with several wanted rows")
    return out.select(query, day, "rows", days_since(day, anchor).alias("days"))


def with_bins(queries: DataFrame, day: str) -> DataFrame:
    """The queries with ``pct`` and ``bin`` (early, middle, late); queries of one day share a bin, without a day they have none."""
    ranked = percentile_ranks(queries, day)
    return ranked.withColumn("bin", tertile("pct"))


def bin_summary(queries: DataFrame, day: str) -> DataFrame:
    """Queries, rows, first and last day and median days of each bin."""
    return queries.where("bin is not null").groupBy("bin").agg(F.count("*").alias("queries"), F.sum("rows").alias("rows"), F.min(day).alias("first"), F.max(day).alias("last"), F.percentile("days", 0.5).alias("median_days"))
