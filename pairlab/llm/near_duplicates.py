"""Groups of records that share most of their wording.

Fast similarity sketches are cut into bands; texts that agree in a band are candidates, and the
exact similarity of their word shingles decides. Texts that are the same are one class from the
start: sketches, candidates and checks are of distinct texts, and copies are attached at the end.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import NOT_ALNUM
from ..operators.components import components
from ..plans.cut import cut
from .sketches import CHARS_AT_ONCE, band_partitions, band_rows, shingles, word_hashes

ALNUM = NOT_ALNUM.replace("^", "")
#: Texts of one band that meet in one task, and pairs made at once by a worker.
BAND_BLOCK, PAIRS_AT_ONCE = 1_000, 1_000_000


def texts_of(df: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """``field``, ``part`` (its number), ``id``, ``text``, ``tid`` and ``tid2`` (hashes of field and text that name it
    together): one row for each row and field.

    ``fields``: name -> (id column, text column). Rows with a null id and null or empty texts are left out."""
    out = None
    for part, (name, (id_col, text_col)) in enumerate(sorted(fields.items())):
        one = df.select(F.lit(name).alias("field"), F.lit(part).alias("part"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null and text <> ''")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("tid", F.xxhash64("part", "text")).withColumn("tid2", F.xxhash64(F.lit("2"), "text", "part"))


def _meet(cross: bool, most: int):
    """Pairs of the texts in each band, from rows in the order of their band, whose last bit is the side (with ``cross``, 0 meets 1 only).

    A band of more than ``most`` texts comes out as these with the numbers of their blocks, and their number, instead."""

    def batch(a=(), b=(), band=None, block=0, side=0) -> pa.RecordBatch:
        n = len(a)
        bands = pa.nulls(n, pa.int64()) if band is None else pa.array(np.full(n, band, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)), bands, pa.array(np.broadcast_to(np.asarray(block, np.int32), n)), pa.array(np.broadcast_to(np.asarray(side, np.int8), n))], names=["a", "b", "band", "block", "side"])

    def pairs(band: np.ndarray, side: np.ndarray, tid: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
        stop = np.r_[new[1:], len(band)]
        run = np.repeat(np.arange(len(new)), stop - new)
        if cross:
            left = np.flatnonzero(side == 0)
            ones = np.r_[0, np.cumsum(side)]
            begin = (stop - (ones[stop] - ones[new]))[run[left]]
        else:
            left = np.arange(len(band))
            begin = left + 1
        n = stop[run[left]] - begin
        left, begin, n = left[n > 0], begin[n > 0], n[n > 0]
        total, i = np.cumsum(n), 0
        while i < len(left):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS_AT_ONCE, "right")))
            k = n[i:j]
            a, b = tid[np.repeat(left[i:j], k)], tid[np.repeat(begin[i:j] - np.cumsum(k) + k, k) + np.arange(k.sum())]
            # A pair has many bands in common; those of one slice are put together here.
            both = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) < PAIRS_AT_ONCE else np.stack([a, b], axis=1)
            yield batch(both[:, 0], both[:, 1])
            i = j

    def large(band: int, at: int, side: np.ndarray, tid: np.ndarray) -> tuple[pa.RecordBatch, int]:
        return batch(tid, tid, band, (at + np.arange(len(tid))) // most, side), at + len(tid)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, tids, open_, passed = np.empty(0, np.int64), np.empty(0, np.int64), None, 0
        for rows in itertools.chain(batches, [None]):
            if rows is not None:
                keys, tids = np.r_[keys, rows.column(0).to_numpy()], np.r_[tids, rows.column(1).to_numpy()]
            if not len(keys):
                continue
            bands = keys >> 1
            # The last band may go on in the next batch.
            whole = int(np.searchsorted(bands, bands[-1])) if rows is not None else len(bands)
            # A band alone has no pairs; of the others, a text counts once.
            near = bands[1:whole] == bands[: whole - 1] if whole else np.empty(0, bool)
            some = np.flatnonzero(np.r_[near, False] | np.r_[False, near]) if whole else np.empty(0, np.int64)
            if open_ is not None and whole and bands[0] == open_:
                some = np.union1d(some, [0])
            k, t = keys[some], tids[some]
            order = np.lexsort((t, k))
            k, t = k[order], t[order]
            once = np.r_[True, (k[1:] != k[:-1]) | (t[1:] != t[:-1])] if len(k) else np.empty(0, bool)
            k, t = k[once], t[once]
            band, side = k >> 1, (k & 1).astype(np.int8)
            starts = np.flatnonzero(np.r_[True, band[1:] != band[:-1]]) if len(band) else np.empty(0, np.int64)
            lengths = np.diff(np.r_[starts, len(band)])
            split = (lengths > most) | (band[starts] == open_ if open_ is not None else False)
            small = np.repeat(~split, lengths)
            if small.any():
                yield from pairs(band[small], side[small], t[small])
            for s, n in zip(starts[split], lengths[split]):
                more, at = large(band[s], passed if band[s] == open_ else 0, side[s : s + n], t[s : s + n])
                yield more
                yield batch([0], [0], band[s], -(-at // most), 2)
            if open_ is not None and bands[-1] != open_ and not (len(band) and band[0] == open_):
                yield batch([0], [0], open_, -(-passed // most), 2)
            if bands[-1] != open_:
                open_, passed = None, 0
            keys, tids = keys[whole:], tids[whole:]
            # An open band with many texts is passed on as it comes.
            if len(keys) > most or (open_ is not None and len(keys)):
                order = np.unique(np.stack([keys & 1, tids], axis=1), axis=0)
                if open_ is None:
                    open_, passed = int(bands[-1]), 0
                more, passed = large(open_, passed, order[:, 0].astype(np.int8), order[:, 1])
                yield more
                keys, tids = keys[:0], tids[:0]
        if open_ is not None:
            yield batch([0], [0], open_, -(-passed // most), 2)

    return meet


def candidates(bands: DataFrame, partitions: int, cross: bool = False, block: int = BAND_BLOCK) -> DataFrame:
    """Distinct pairs ``a``, ``b`` of texts with a common band: ``a`` < ``b``, or with ``cross`` a of side 0 and b of side 1
    (the band's last bit).

    Rows of a band meet in one shuffle, in order. A band of more than ``block`` texts is cut into blocks; its
    pairs of blocks are tasks of their own. Repeated rows count once."""
    # Sorted by one number, so by its bytes.
    rows = bands.select("band", "tid").repartition(partitions, F.shiftright("band", 1)).sortWithinPartitions("band")
    met = cut(rows.mapInArrow(_meet(cross, block), "a long, b long, band long, block int, side byte"))
    count = met.where("side = 2").select("band", F.col("block").alias("blocks"))
    parts = met.where("band is not null and side < 2").select("band", "side", F.col("a").alias("tid"), "block").join(count, "band")
    lead, follow = (parts.where("side = 0"), parts.where("side = 1")) if cross else (parts, parts)
    # Without sides each pair of blocks meets once.
    i = F.explode(F.sequence(F.lit(0) if cross else F.col("block"), F.col("blocks") - 1))
    j = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1 if cross else F.col("block")))
    x = lead.select("band", F.col("block").alias("i"), i.alias("j"), F.col("tid").alias("a"))
    y = follow.select("band", j.alias("i"), F.col("block").alias("j"), F.col("tid").alias("b"))
    keys = ["band", "i", "j"]
    large = x.repartition(partitions, *keys).join(y.repartition(partitions, *keys), keys)
    large = large if cross else large.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return met.where("band is null").select("a", "b").union(large.select("a", "b")).distinct()


def verify(shingle: int, least: float):
    """Exact Jaccard similarity of the shingle sets of ``ta`` and ``tb``; keeps pairs from ``least`` on."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ta, tb = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
            lo = 0
            while lo < len(ta):
                hi, held, number = lo, 0, {}
                # A text of several pairs is cut up once.
                while hi < len(ta) and held < CHARS_AT_ONCE:
                    for t in (ta[hi], tb[hi]):
                        if t not in number:
                            number[t] = len(number)
                            held += len(t)
                    hi += 1
                items, text = shingles(*word_hashes(list(number)), shingle)
                cuts = np.searchsorted(text, np.arange(len(number) + 1))
                sets = [set(items[x:y].tolist()) for x, y in zip(cuts[:-1], cuts[1:])]
                both = [(sets[number[x]], sets[number[y]]) for x, y in zip(ta[lo:hi], tb[lo:hi])]
                shared = [len(x & y) for x, y in both]
                total = [len(x) + len(y) - s for (x, y), s in zip(both, shared)]
                keep = [i for i, (s, n) in enumerate(zip(shared, total)) if n and s >= least * n - 1e-9]
                if keep:
                    part = batch.slice(lo, hi - lo).select(["a", "a2", "b", "b2"]).take(pa.array(keep))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([shared[i] for i in keep], pa.int32()), pa.array([total[i] for i in keep], pa.int32())], names=["a", "a2", "b", "b2", "shared", "total"])
                lo = hi

    return check


def similar_texts(texts: DataFrame, least: float, shingle: int, bands: int, rows: int, partitions: int) -> DataFrame:
    """``a``, ``a2``, ``b``, ``b2``, ``shared``, ``total``: pairs of different texts with a similarity of ``least`` or more."""
    # Formatting may differ where the words don't: such texts are pairs with similarity 1.
    pairs = cut(candidates(band_rows(texts, bands, rows, shingle), partitions))
    plain = texts.select("tid", "tid2", "text")
    wanted = pairs.select(F.col("a").alias("tid")).union(pairs.select("b")).distinct()
    # A row's text is no larger than its bands, about, so as many partitions do for both.
    few = cut(plain.repartition(partitions, "tid").join(wanted, "tid", "left_semi").groupBy("tid", "tid2").agg(F.min("text").alias("text")))
    named = lambda k: few.select(F.col("tid").alias(k), F.col("tid2").alias(f"{k}2"), F.col("text").alias(f"t{k}"))
    held = pairs.join(named("a"), "a").join(named("b"), "b")
    return held.select("a", "a2", "b", "b2", "ta", "tb").mapInArrow(verify(shingle, least), "a long, a2 long, b long, b2 long, shared int, total int")


def near_duplicate_pairs(df: DataFrame, fields: dict[str, tuple[str, str]], least: float = 0.8, shingle: int = 5, bands: int = 32, rows: int = 4) -> DataFrame:
    """``field``, ``id_a`` < ``id_b``: all pairs of records of ``df`` whose texts have a similarity of ``least`` or more.

    The similarity is the number of distinct sequences of ``shingle`` words in both over that in either.
    ``fields``: name -> (id column, text column); an id that comes again with the same text counts once.
    A pair of similarity s is missed with probability (1 - s ** rows) ** bands. Null and empty
    texts and texts of fewer than ``shingle`` words are in no pair. Copies are expanded here, as the
    result is one row a pair; near_duplicate_groups doesn't.
    """
    texts = texts_of(df, fields)
    pairs = cut(similar_texts(texts, least, shingle, bands, rows, band_partitions(df, len(fields) * bands)).select("a", "a2", "b", "b2"))
    # A text with so many words; the search ends at the last of them.
    long_enough = F.lower("text").rlike(f"(?:{ALNUM}+{NOT_ALNUM}+){{{shingle - 1}}}{ALNUM}")
    members = cut(texts.where(long_enough).select("field", "id", "tid", "tid2").distinct())
    repeated = members.groupBy("tid", "tid2").agg(F.count("*").alias("c")).where("c > 1").selectExpr("tid a", "tid2 a2", "tid b", "tid2 b2")
    left, right = members.selectExpr("field", "id x", "tid a", "tid2 a2"), members.selectExpr("id y", "tid b", "tid2 b2")
    tied = pairs.union(repeated).join(left, ["a", "a2"]).join(right, ["b", "b2"]).where("x <> y")
    return tied.select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_duplicate_groups(df: DataFrame, fields: dict[str, tuple[str, str]], least: float = 0.8, shingle: int = 5, bands: int = 32, rows: int = 4) -> DataFrame:
    """``field``, ``id``, ``group_id``, ``links``: for each record its group (the least id of the records tied to it,
    through others too) and the number of other texts that it is similar to itself. Copies are not paired.

    Records whose text is null, empty or too short for a shingle are groups of their own copies.
    """
    texts = texts_of(df, fields)
    key = F.concat_ws(":", F.hex("tid"), F.hex("tid2")).alias("text_key")
    members = cut(texts.select("field", "id", key).distinct())
    found = similar_texts(texts, least, shingle, bands, rows, band_partitions(df, len(fields) * bands))
    pairs = cut(found.select(F.concat_ws(":", F.hex("a"), F.hex("a2")).alias("a"), F.concat_ws(":", F.hex("b"), F.hex("b2")).alias("b")))
    links = pairs.select(F.col("a").alias("text_key")).union(pairs.select("b")).groupBy("text_key").agg(F.count("*").alias("links"))
    classes = components(pairs, "a", "b").select(F.col("node").alias("text_key"), "component")
    named = members.join(classes, "text_key", "left").join(links, "text_key", "left").select("field", "id", F.coalesce("component", "text_key").alias("comp"), F.coalesce("links", F.lit(0)).alias("links"))
    least_id = named.groupBy("field", "comp").agg(F.min("id").alias("group_id"))
    return named.join(least_id, ["field", "comp"]).groupBy("field", "id").agg(F.min("group_id").alias("group_id"), F.sum("links").alias("links"))
