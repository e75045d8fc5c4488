"""Streaming forms of a few aggregations, as an extension: the batch operators need none of this."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.cut import scratch


def read_events(spark: SparkSession, path: str, schema: T.StructType, time: str) -> DataFrame:
    """A stream of the Parquet files that appear below ``path``, with ``time`` as a timestamp that watermarks accept."""
    return spark.readStream.schema(schema).parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def windowed_counts(stream: DataFrame, time: str, kind: str, value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count and sum in tumbling windows; rows later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("rows"), F.sum(value).alias("total"))


def first_seen(stream: DataFrame, time: str, key: str, late: str = "2 days") -> DataFrame:
    """Each key's first row within the watermark: repeated deliveries are dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns the result: the last state in complete mode, else all rows appended.

    State and results lie in the shared checkpoint folder, so a lost executor or a stopped driver costs at most a batch."""
    spark = stream.sparkSession
    path = scratch(spark, name)
    batches = []

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch-{number}")
        batches.append(f"{path}/batch-{number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(save).trigger(availableNow=True).start()
    q.awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(*(batches[-1:] if mode == "complete" else batches))
