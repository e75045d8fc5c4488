"""Paragraphs that share most of their wording, in clusters of which one is kept.

Paragraph sketches are cut into bands tuned for recall, colliding paragraphs are joined, the exact
Jaccard similarity of their word shingles decides, and components of the pairs are the clusters.

This finds paragraphs that are alike as wholes. A stretch that two otherwise different paragraphs share
is below any similarity that is worth searching, so ``shared_spans`` doesn't start from these pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_duplicates import near_duplicate_groups


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, number, start, part = [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            at = 0
            for k, p in enumerate(text.split("\n")):
                if p:
                    row.append(i)
                    number.append(k)
                    start.append(at)
                    part.append(p)
                at += len(p) + 1
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(np.array(number, np.int32)), pa.array(np.array(start, np.int64)), pa.array(part, pa.string())], names=["rec", "paragraph", "start_char", "text"])


def paragraphs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rec``, ``paragraph`` (its place among the lines, from 0), ``start_char``, ``text`` of each line that isn't empty."""
    source = df.select(F.col(id_col).alias("rec"), F.col(text_col).alias("text")).where("rec is not null and text <> ''")
    return source.mapInArrow(_cut, f"rec {dict(source.dtypes)['rec']}, paragraph int, start_char long, text string")


def paragraph_clusters(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, shingle: int = 5, bands: int = 48, rows: int = 4) -> DataFrame:
    """``id_col``, ``paragraph``, ``start_char``, ``end_char``, ``cluster_id``, ``links``, ``removed`` of each paragraph that is like another one.

    ``cluster_id`` is the least "id:paragraph" of the cluster, the one that is kept; ``links`` the number of other texts that
    it is similar to. A pair at exactly 0.8 is missed with probability (1 - 0.8 ** rows) ** bands, 5e-12. Null and empty
    texts, rows with a null id and paragraphs of fewer than ``shingle`` words, unless copied, have no row; of several rows with
    one id and paragraph each has its own.
    """
    parts = paragraphs(df, id_col, text_col).withColumn("pid", F.concat_ws(":", F.col("rec").cast("string"), "paragraph"))
    groups = near_duplicate_groups(parts, {"text": ("pid", "text")}, least, shingle, bands, rows).select(F.col("id").alias("pid"), F.col("group_id").alias("cluster_id"), "links")
    several = groups.groupBy("cluster_id").agg(F.count("*").alias("c")).where("c > 1").select("cluster_id")
    places = parts.select("pid", F.col("rec").alias(id_col), "paragraph", "start_char", (F.col("start_char") + F.length("text")).alias("end_char"))
    found = groups.join(several, "cluster_id").join(places, "pid")
    return found.select(id_col, "paragraph", "start_char", "end_char", "cluster_id", "links", (F.col("pid") != F.col("cluster_id")).alias("removed"))
