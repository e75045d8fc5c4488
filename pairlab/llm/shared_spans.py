"""Stretches of text that occur unchanged in another record.

Paragraph sketches can't find a stretch that is a small part of two paragraphs, so
the search uses local fingerprints instead: of the fingerprints of all ``gram``
characters inside a window of ``span`` characters the least is kept, with its
position. Equal windows keep equal fingerprints, so no shared window is missed,
and only fingerprints that two records have are looked at again.

A kept fingerprint stands for the windows that chose it (its run). Runs with the same
text form one class; a class found in two records is shared whole, whatever the number
of its copies, and no pairs are formed. Only where a fingerprint has several classes
(at the ends of a shared stretch) are the windows of one run of each class compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.cut import cut
from .arrays import U64, Rolling, code_points, mix, segments, sliding_min

#: Characters handled at once by a worker, below 2 ** POSITION_BITS.
SEGMENT, POSITION_BITS = 400_000, 20


def _shape(off: np.ndarray, n: np.ndarray) -> np.ndarray:
    return mix((off.astype(U64) << U64(32)) | n.astype(U64))


def _runs(span: int, gram: int):
    width = span - gram + 1
    low = (1 << POSITION_BITS) - 1
    assert width > 0 and SEGMENT + 2 * span < low

    def one(rows, starts, pieces):
        lengths = np.array([len(p) for p in pieces])
        chars = code_points("".join(pieces))
        ends = np.cumsum(lengths)
        rolling = Rolling(chars)
        grams = rolling.all(gram)
        # Ties take the last position, so the choice depends on the window's text only.
        place = np.arange(len(grams), dtype=U64)
        chosen = low - (sliding_min((grams & ~U64(low)) | (U64(low) - place), width) & U64(low)).astype(np.int64)
        piece = np.repeat(np.arange(len(pieces)), lengths)[: len(chosen)]
        at = np.flatnonzero(np.arange(len(chosen)) + span <= ends[piece]) if len(chosen) else np.empty(0, np.int64)
        if not len(at):
            return None
        key, piece = chosen[at], piece[at]
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])])
        last = np.r_[first[1:], len(at)] - 1
        lo, hi, pos, piece = at[first], at[last], key[first], piece[first]
        content = rolling.some(lo, hi + span) ^ _shape(pos - lo, hi - lo + 1)
        begin = ends[piece] - lengths[piece]
        return grams[pos].view(np.int64), content.view(np.int64), np.array(rows)[piece], lo - begin + np.array(starts)[piece], hi - lo + 1, pos - lo

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for group in segments(texts, SEGMENT, span - 1):
                if (found := one(*group)) is None:
                    continue
                gram_hash, content, row, lo, n, off = found
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram_hash), pa.array(content), ids.take(pa.array(row)), pa.array(lo.astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32))],
                    names=["fp", "content", "rec", "lo", "n", "off"],
                )

    return runs


def _windows(span: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("piece").to_pylist()
            content, shape = batch.column("content").to_numpy().view(U64), _shape(batch.column("off").to_numpy(), batch.column("n").to_numpy())
            step = max(1, SEGMENT // (2 * span))
            for a in range(0, len(texts), step):
                part = texts[a : a + step]
                lengths = np.array([len(t) for t in part])
                rolling = Rolling(code_points("".join(part)))
                hashes = rolling.all(span)
                begin = np.cumsum(lengths) - lengths
                # Of several rows with one id, only the one that the run came from counts.
                own = (rolling.some(begin, begin + lengths) ^ shape[a : a + step]) == content[a : a + step]
                counts = (lengths - span + 1) * own
                row = np.repeat(np.arange(len(part)), counts)
                j = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                rows = batch.slice(a, len(part)).select(["fp", "content", "d0", "d1"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(j.astype(np.int32)), pa.array(hashes[begin[row] + j].view(np.int64))],
                    names=["fp", "content", "d0", "d1", "j", "h"],
                )

    return windows


def shared_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 200, gram: int = 64) -> DataFrame:
    """The longest unbroken runs of shared characters: ``id_col``, ``start_char``, ``end_char``.

    A character is shared if it lies in a stretch of exactly ``span`` characters that
    occurs in the text of another id. Positions are code points, the end is exclusive.
    Null, empty and shorter texts have none; rows with the same id count as one record;
    rows with a null id take no part. Other columns are ignored. An empty table gives an
    empty result. Every position of every text counts; long texts are handled in
    overlapping pieces.
    """
    ids, kind = F.col(id_col), dict(df.dtypes)[id_col]
    source = df.select(ids.alias("rec"), F.col(text_col).alias("text")).where("rec is not null and length(text) >= %d" % span)
    runs = source.mapInArrow(_runs(span, gram), f"fp long, content long, rec {kind}, lo long, n int, off int")
    common = runs.groupBy("fp").agg(F.min("rec").alias("d0"), F.max("rec").alias("d1")).where("d0 < d1").select("fp")
    held = cut(runs.join(common, "fp", "left_semi"))
    classes = cut(held.groupBy("fp", "content").agg(F.min("rec").alias("d0"), F.max("rec").alias("d1"), F.min(F.struct("rec", "lo", "n", "off")).alias("one")))
    whole = held.join(classes.where("d0 < d1").select("fp", "content"), ["fp", "content"], "left_semi").select("rec", "lo", (F.col("lo") + F.col("n") - 1 + span).alias("hi"))

    mixed = classes.groupBy("fp").agg(F.count("*").alias("c"), F.count_if(F.col("d0") == F.col("d1")).alias("single")).where("c > 1 and single > 0").select("fp")
    some = classes.join(mixed, "fp", "left_semi").select("fp", "content", "d0", "d1", F.col("one.rec").alias("rec"), F.col("one.lo").alias("at"), F.col("one.n").alias("n"), F.col("one.off").alias("off"))
    pieces = some.join(source, "rec").select("fp", "content", "d0", "d1", "n", "off", F.expr(f"substring(text, cast(at as int) + 1, n + {span - 1})").alias("piece")).where(F.length("piece") >= span)
    windows = pieces.mapInArrow(_windows(span), f"fp long, content long, d0 {kind}, d1 {kind}, j int, h long")
    twice = windows.groupBy("fp", "h").agg(F.min("d0").alias("m0"), F.max("d1").alias("m1")).where("m0 < m1").select("fp", "h")
    # At most span - gram + 1 windows to a class.
    ends = windows.where("d0 = d1").join(twice, ["fp", "h"], "left_semi").groupBy("fp", "content").agg(F.collect_set("j").alias("js"))
    partly = held.join(ends, ["fp", "content"]).select("rec", "lo", F.explode("js").alias("j")).select("rec", (F.col("lo") + F.col("j")).alias("lo"), (F.col("lo") + F.col("j") + span).alias("hi"))
    return merge_ranges(whole.unionByName(partly), "rec", "lo", "hi").select(F.col("rec").alias(id_col), F.col("lo").alias("start_char"), F.col("hi").alias("end_char"))


def merge_ranges(df: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """Overlapping and touching ranges of each key as one: ``key``, ``lo``, ``hi``."""
    by = W.partitionBy(key).orderBy(lo, hi)
    reached = F.max(hi).over(by.rowsBetween(W.unboundedPreceding, -1))
    marked = df.select(key, lo, hi, F.when(reached >= F.col(lo), 0).otherwise(1).alias("__new"))
    numbered = marked.withColumn("__run", F.sum("__new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "__run").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("__run")


def shared_share(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 200, gram: int = 64) -> DataFrame:
    """How much of each text is shared: ``id_col``, ``n_chars``, ``shared_chars``, ``shared_share``.

    One row per input row with an id; a null or empty text has 0 characters and a null share.
    Of several rows with one id, each gets the id's shared characters.
    """
    spans = shared_spans(df, id_col, text_col, span, gram).groupBy(id_col).agg(F.sum(F.col("end_char") - F.col("start_char")).alias("shared_chars"))
    sizes = df.where(F.col(id_col).isNotNull()).select(id_col, F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars"))
    out = sizes.join(spans, id_col, "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    return out.withColumn("shared_share", F.round(F.col("shared_chars") / F.nullif("n_chars", F.lit(0)), 6))
