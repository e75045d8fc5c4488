"""Copies that differ in formatting only.

Canonical records are range-partitioned by a hash of their key and the record's id, sorted, and
read once: neighbours with the same full key form a run, whose first record is kept. As the
id is part of the order, a key that a third of all records share fills many partitions; the
runs at the partitions' edges, two at most for each, are put together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut

#: What a row of the scan is: a copy inside the partition, a row of a run at its edge, such a run, a run inside.
_COPY, _EDGE_ROW, _EDGE_RUN, _RUN = range(4)


def _scan(kind: pa.DataType):
    fields = pa.schema([("what", pa.int32()), ("run", pa.int32()), ("row_id", kind), ("head", kind), ("key", pa.string()), ("n", pa.int64())])

    def rows(what, run, row_id, head, key, n) -> pa.RecordBatch:
        size = len(head)
        spread = lambda v, t: pa.array(np.broadcast_to(np.asarray(v), size).astype(t))
        return pa.RecordBatch.from_arrays([spread(what, np.int32), spread(run, np.int32), pa.nulls(size, kind) if row_id is None else row_id, head, pa.nulls(size, pa.string()) if key is None else key, spread(n, np.int64)], schema=fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The run that goes on: its number, key, head and records so far.
        run, key, head, n = -1, None, None, 0
        for b in batches:
            keys, ids, size = b.column("key"), b.column("row_id"), b.num_rows
            if not size:
                continue
            new = np.ones(size, dtype=bool)
            new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            new[0] = run < 0 or keys[0].as_py() != key
            at, starts = np.arange(size), np.flatnonzero(new)
            begin = np.maximum.accumulate(np.where(new, at, -1))
            number = run + np.cumsum(new)
            count = np.where(begin < 0, n + at + 1, at - begin + 1)
            heads = pa.concat_arrays([pa.array([head], kind), ids])
            # Rows of the first run may go on from the partition before; of other runs a lone row has no copy yet.
            edge, copy, second = number == 0, (number > 0) & (count > 1), (number > 0) & (count == 2)
            for some, what in ((edge, _EDGE_ROW), (copy, _COPY)):
                if some.any():
                    yield rows(what, np.minimum(number[some], 1), ids.filter(pa.array(some)), heads.take(pa.array(begin[some] + 1)), None, 1)
            if second.any():
                first = heads.take(pa.array(begin[second] + 1))
                yield rows(_COPY, 1, first, first, None, 1)
            # Runs that end before one of these starts.
            ended = starts if run >= 0 else starts[1:]
            if len(ended):
                last = ended - 1
                before = np.where(last < 0, -1, begin[np.maximum(last, 0)])
                numbers = np.where(last < 0, run, number[np.maximum(last, 0)])
                counts = np.where(last < 0, n, count[np.maximum(last, 0)])
                names = pa.concat_arrays([pa.array([key], pa.string()), keys]).take(pa.array(np.where(numbers == 0, last + 1, 0)))
                told = pc.if_else(pa.array(numbers == 0), names, pa.scalar(None, pa.string()))
                yield rows(np.where(numbers == 0, _EDGE_RUN, _RUN), np.minimum(numbers, 1), None, heads.take(pa.array(before + 1)), told, counts)
            run, key, n = int(number[-1]), keys[size - 1].as_py(), int(count[-1])
            head = heads[int(begin[-1]) + 1].as_py()
        if run >= 0:
            yield rows(_EDGE_RUN, min(run, 1), None, pa.array([head], kind), pa.array([key], pa.string()), n)
            if run > 0 and n == 1:
                yield rows(_EDGE_ROW, 1, pa.array([head], kind), pa.array([head], kind), None, 1)

    return scan


def _scanned(df: DataFrame, id_col: str, key: Column, partitions: int | None) -> DataFrame:
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(df.dtypes)[id_col]
    records = df.select(F.col(id_col).alias("row_id"), key.alias("key")).where("row_id is not null and key is not null").withColumn("h", F.xxhash64("key"))
    ranged = records.repartitionByRange(n, "h", "row_id").sortWithinPartitions("h", "key", "row_id")
    arrow = pa.string() if kind == "string" else pa.int64()
    if kind != "string":
        ranged = ranged.withColumn("row_id", F.col("row_id").cast("long"))
    scanned = ranged.select("key", "row_id").mapInArrow(_scan(arrow), f"what int, run int, row_id {'string' if kind == 'string' else 'long'}, head {'string' if kind == 'string' else 'long'}, key string, n long")
    # Range borders are sampled, so the scan is kept rather than done twice.
    return cut(scanned.withColumn("part", F.spark_partition_id()))


def _edges(scanned: DataFrame) -> DataFrame:
    """For each run at an edge: the head and number of records of the whole run."""
    runs = scanned.where(F.col("what") == _EDGE_RUN)
    whole = runs.groupBy("key").agg(F.min("head").alias("first"), F.sum("n").alias("total"))
    return runs.join(whole, "key").select("part", F.col("head"), "first", "total")


def copies(df: DataFrame, id_col: str, key: Column, partitions: int | None = None) -> DataFrame:
    """``row_id``, ``kept_row_id`` of each record with a copy, the kept one (the least id) too.

    ``key`` is the canonical record; records with a null key or id take part in nothing. Rows with
    the same id and key count as copies of each other and come out once.
    """
    scanned = _scanned(df, id_col, key, partitions)
    rows = scanned.where(F.col("what").isin(_COPY, _EDGE_ROW))
    # Two runs for each partition at most, without their texts.
    joined = rows.join(F.broadcast(_edges(scanned)), ["part", "head"], "left")
    kept = joined.where(F.coalesce("total", F.lit(2)) > 1)
    return kept.select("row_id", F.coalesce("first", "head").alias("kept_row_id")).distinct()


def collapsed(df: DataFrame, id_col: str, key: Column, partitions: int | None = None) -> DataFrame:
    """One record for each set of copies: ``kept_row_id`` (the least id) and ``copies``, its number of records."""
    scanned = _scanned(df, id_col, key, partitions)
    inner = scanned.where(F.col("what") == _RUN).select(F.col("head").alias("kept_row_id"), F.col("n").alias("copies"))
    outer = _edges(scanned).select(F.col("first").alias("kept_row_id"), F.col("total").alias("copies")).distinct()
    return inner.unionByName(outer)
