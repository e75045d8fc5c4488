"""Streaming extension (x01)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.events import read_events, run_once, windowed_counts
from .registry import query, table


@query("SELECT ts::DATE AS day, event_type, count(*) AS rows, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def x01_stream_daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    stream = read_events(spark, f"{folder}/events.parquet*", schema, "ts")
    out = run_once(windowed_counts(stream, "ts", "event_type", "value"), "daily")
    return out.select(F.col("window.start").cast("date").alias("day"), "event_type", "rows", F.round("total", 4).alias("total"))
