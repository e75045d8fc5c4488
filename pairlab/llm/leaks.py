"""Passages of a query set (held-out items) inside a large set of documents.

Spaced seeds: a window of ``width`` words is hashed once under each of a few fixed masks,
each of which ignores other positions, so that windows that differ in ignored positions
only still meet. Hits are verified word by word, with the substitutions allowed.

The items' seeds go to every worker as sorted arrays while they are below a checked
bound; documents are then only scanned. Larger item sets meet the documents' seeds in a
shuffle join of numbers; a filter of bounded size drops document windows before they move.
Both ways give the same hits, which are put together in one way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_key
from ..plans.cut import cut
from .arrays import U64, mix
from .sketches import chunks, word_hashes

_WORD = re.compile(r"[^\W_]+")
#: Bits of the table that drops most windows without a search.
_FILTER_BITS = 22
#: Words of documents, and hits, handled at once by a worker.
_WORDS_AT_ONCE, _HITS_AT_ONCE = 400_000, 1_000_000
#: Bits a seed of the filter for large item sets, and the logarithm of most bits in all (32 MB); hashes of a seed.
_BITS_A_SEED, _MOST_BITS, _FILTER_HASHES = 12, 28, 4


def masks(width: int, count: int) -> list[np.ndarray]:
    """Positions that each mask looks at; mask m ignores the inner positions that leave the rest m
    when divided by ``count``. A window of one word has one mask."""
    if width == 1 or count <= 1:
        return [np.arange(width)]
    return [np.array([p for p in range(width) if p % count != m]) for m in range(min(count, width))]


def _seeds(ids: np.ndarray, width: int, seen: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of the windows of ``width`` ids under one mask."""
    n = len(ids) - width + 1
    values = mix(ids.astype(U64) + U64(0x632BE59BD9B4E019))
    out = np.full(n, mix(np.array([width * 64 + salt], dtype=U64))[0], dtype=U64)
    for p in seen:
        out += values[p : p + n] * (mix(np.array([p + 1], dtype=U64))[0] | U64(1))
    return mix(out)


class SeedIndex:
    """Seeds of the items: window widths, their masks, and for each seed the item windows that have it."""

    def __init__(self, item_ids: list, words: list[list[str]], width: int, mask_count: int):
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for ws in words for w in ws}))}
        self.item_ids, self.tables, self.filter = item_ids, [], np.zeros(1 << _FILTER_BITS, dtype=bool)
        coded = [np.array([self.vocabulary[w] for w in ws], dtype=np.int64) for ws in words]
        by_width: dict[int, list[int]] = {}
        for i, c in enumerate(coded):
            if len(c):
                by_width.setdefault(min(width, len(c)), []).append(i)
        for size, members in sorted(by_width.items()):
            flat = np.concatenate([coded[i] for i in members])
            lengths = np.array([len(coded[i]) for i in members])
            item = np.repeat(np.array(members), lengths)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            ok = np.flatnonzero(at + size <= np.repeat(lengths, lengths))
            for m, seen in enumerate(masks(size, mask_count)):
                seeds = _seeds(flat, size, seen, m)[ok]
                order = np.argsort(seeds, kind="stable")
                self.filter[seeds >> U64(64 - _FILTER_BITS)] = True
                self.tables.append((size, m, seen, seeds[order], item[ok][order], at[ok][order]))
        self.coded = coded

    def hits(self, coded: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """For each width and mask: document positions, items and equal words of the windows with a common seed.
        ``ends``: for each position, where its document ends."""
        for size, m, seen, seeds, item, at in self.tables:
            if len(coded) < size:
                continue
            found = _seeds(coded, size, seen, m)
            pos = np.flatnonzero(self.filter[found >> U64(64 - _FILTER_BITS)])
            pos = pos[pos + size <= ends[pos]]
            lo = np.searchsorted(seeds, found[pos], "left")
            n = np.searchsorted(seeds, found[pos], "right") - lo
            pos, lo, n = pos[n > 0], lo[n > 0], n[n > 0]
            offsets = np.cumsum([0, *map(len, self.coded)])[:-1]
            flat = self._flat
            # A window that many items hold gives many hits; they come in slices.
            total, a = np.cumsum(n), 0
            while a < len(pos):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + _HITS_AT_ONCE, "right")))
                k = n[a:b]
                entry = np.repeat(lo[a:b] - np.cumsum(k) + k, k) + np.arange(k.sum())
                where = np.repeat(pos[a:b], k)
                equal = np.zeros(len(where), dtype=np.int64)
                for p in range(size):
                    equal += coded[where + p] == flat[offsets[item[entry]] + at[entry] + p]
                yield size, where, item[entry], equal
                a = b

    @property
    def _flat(self) -> np.ndarray:
        if "flat" not in self.__dict__:
            self.flat = np.concatenate(self.coded)
        return self.flat


def _scan(shared, max_substitutions: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: SeedIndex = shared.value
        known = index.vocabulary.get
        items = pa.array(index.item_ids)
        for batch in batches:
            ids = batch.column(0)
            rows, held, coded = [], 0, []

            def flush():
                lengths = np.array([len(c) for c in coded])
                row = np.repeat(np.array(rows), lengths)
                ends = np.repeat(np.cumsum(lengths), lengths)
                begin = ends - np.repeat(lengths, lengths)
                parts = []
                for size, pos, item, equal in index.hits(np.concatenate(coded), ends):
                    keep = equal >= size - max_substitutions
                    parts.append(pd.DataFrame({"row": row[pos[keep]], "item": item[keep], "pos": pos[keep] - begin[pos[keep]], "size": size, "equal": equal[keep]}))
                if not parts:
                    return None
                # The same window under several masks, or equal to several of the item's, is one hit.
                best = pd.concat(parts).groupby(["row", "item", "pos", "size"], as_index=False)["equal"].max()
                return _hit_batch(items.take(pa.array(best["item"])), ids.take(pa.array(best["row"])), best["pos"], best["size"], best["equal"]) if len(best) else None

            for row, text in enumerate(batch.column(1).to_pylist()):
                words = _WORD.findall(text.lower()) if text else ()
                if not words:
                    continue
                rows.append(row)
                coded.append(np.fromiter((known(w, 0) for w in words), dtype=np.int64, count=len(words)))
                held += len(words)
                if held > _WORDS_AT_ONCE:
                    if (out := flush()) is not None:
                        yield out
                    rows, held, coded = [], 0, []
            if rows and (out := flush()) is not None:
                yield out

    return scan


def _hit_batch(item: pa.Array, doc: pa.Array, *numbers) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([item, doc, *(pa.array(np.asarray(n).astype(np.int32)) for n in numbers)], names=["item", "doc", "pos", "size", "equal"])


def leaks(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 13,
    mask_count: int = 4,
    max_substitutions: int = 1,
    max_shared_words: int = 500_000,
) -> DataFrame:
    """Documents that hold all or part of an item, with the items they hold.

    A part is ``width`` consecutive words of the item, all words of a shorter item. It counts
    where at most ``max_substitutions`` of its words are replaced and the replaced positions are
    ignored by one of the ``mask_count`` masks. As each position is ignored by one of them, no part
    with a single replaced word is missed, and none without any.

    One row per item and document: ``item``, ``doc``, ``equal_words`` of the best window,
    ``window_words``, ``windows`` (first words, in any row of the document, of windows found), ``first_word``
    and ``last_word`` of the document that they span (from 0). Null and empty texts take part in nothing,
    nor do rows with a null id; repeated rows change nothing. Items of more than ``max_shared_words`` words
    in all (about 100 bytes of seeds a word) are joined by shuffle instead of being sent to every worker,
    with the same result.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text")).where("doc is not null and text <> ''")
    held = items.select(F.col(item_id).alias("item"), word_key(item_text).alias("key")).where("item is not null and key <> ''").dropDuplicates()
    size = held.agg(F.sum(F.length("key") - F.length(F.replace("key", F.lit(" "))) + 1).alias("n")).first().n or 0
    if size > max_shared_words:
        hits = _hits_by_join(docs, held, width, mask_count, max_substitutions)
    else:
        rows = sorted(held.collect())  # below the bound just checked
        index = SeedIndex([r.item for r in rows], [r.key.split(" ") for r in rows], width, mask_count)
        kinds = dict(held.dtypes)["item"], dict(docs.dtypes)["doc"]
        hits = docs.mapInArrow(_scan(spark.sparkContext.broadcast(index), max_substitutions), "item {}, doc {}, pos int, size int, equal int".format(*kinds))
    # Only hits move. Positions are made distinct before they are counted, so no list of them is held.
    windows = hits.groupBy("item", "doc", "pos").agg(F.max("equal").alias("equal"), F.max("size").alias("size"))
    return windows.groupBy("item", "doc").agg(
        F.max("equal").alias("equal_words"), F.max("size").alias("window_words"), F.count("*").cast("int").alias("windows"), F.min("pos").cast("long").alias("first_word"), F.max(F.col("pos") + F.col("size") - 1).cast("long").alias("last_word")
    )


class SeedFilter:
    """Which seeds an item may have: a bitmap of at most 32 MB whatever the number of items."""

    def __init__(self, bits: int, slots: np.ndarray, values: np.ndarray):
        self.bits, self.words = bits, np.zeros(1 << (bits - 6), dtype=U64)
        self.words[slots] = values

    @staticmethod
    def places(seeds: np.ndarray, k: int, bits: int) -> np.ndarray:
        return mix(seeds + U64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)) >> U64(64 - bits)

    def passing(self, seeds: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Those of the positions ``at`` whose seed may be an item's."""
        for k in range(_FILTER_HASHES):
            p = self.places(seeds[at], k, self.bits)
            at = at[(self.words[p >> U64(6)] >> (p & U64(63))) & U64(1) == 1]
        return at


def _filter_bits(bits: int):
    """The filter's words that each batch of seeds sets, and their bits."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = np.unique(batch.column(0).to_numpy()).view(U64)
            p = np.concatenate([SeedFilter.places(seeds, k, bits) for k in range(_FILTER_HASHES)])
            yield pa.RecordBatch.from_arrays([pa.array((p >> U64(6)).astype(np.int64)), pa.array((U64(1) << (p & U64(63))).view(np.int64))], names=["slot", "bits"])

    return place


def _seed_rows(width: int, mask_count: int, sizes: list[int], own: bool, shared=None):
    """Seeds of the texts' windows with their first word and 32 bits of each word that the mask ignores. ``own``: each
    text has windows of one size, its items'; else of all ``sizes``, if they pass the filter ``shared``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in chunks(batch.column(1).to_pylist()):
                words, text = word_hashes(part)
                lengths = np.bincount(text, minlength=len(part))
                begin = np.cumsum(lengths) - lengths
                for size in sizes:
                    if len(words) < size:
                        continue
                    at = np.flatnonzero(text[: len(words) - size + 1] == text[size - 1 :])
                    if own:
                        at = at[np.minimum(lengths[text[at]], width) == size]
                    for m, seen in enumerate(masks(size, mask_count)):
                        seeds = _seeds(words, size, seen, m)
                        kept = at if shared is None else shared.value.passing(seeds, at)
                        if not len(kept):
                            continue
                        ignored = np.setdiff1d(np.arange(size), seen)
                        rest = (words[kept[:, None] + ignored[None, :]] & U64(0xFFFFFFFF)).astype(np.uint32).view(np.int32).reshape(-1)
                        rests = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * len(ignored)), pa.array(rest, pa.int32()))
                        rows = batch.column(0).take(pa.array(first + text[kept]))
                        yield pa.RecordBatch.from_arrays([pa.array(seeds[kept].view(np.int64)), rows, pa.array((kept - begin[text[kept]]).astype(np.int32)), pa.array(np.full(len(kept), size, np.int32)), rests], names=["seed", "rec", "pos", "size", "rest"])

    return make


def _hits_by_join(docs: DataFrame, held: DataFrame, width: int, mask_count: int, max_substitutions: int) -> DataFrame:
    """The hits of ``leaks`` by a shuffle join of 64-bit seeds; a seed that many documents have is split by AQE.

    Words are compared by hashes: 64 bits of all that the mask looks at, 32 bits of each other word."""
    spark = docs.sparkSession
    n_words = F.length("key") - F.length(F.replace("key", F.lit(" "))) + 1
    # At most ``width`` different sizes.
    sizes = sorted(r.size for r in held.select(F.least(F.lit(width), n_words).alias("size")).distinct().collect())
    schema = "seed long, rec {}, pos int, size int, rest array<int>"
    mine = cut(held.mapInArrow(_seed_rows(width, mask_count, sizes, True), schema.format(dict(held.dtypes)["item"])))
    bits = min(_MOST_BITS, max(16, int(np.ceil(np.log2(_BITS_A_SEED * max(1, mine.count()))))))
    # At most 2 ** (bits - 6) rows, four million.
    slots = mine.select("seed").mapInArrow(_filter_bits(bits), "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toPandas()
    passing = spark.sparkContext.broadcast(SeedFilter(bits, slots["slot"].to_numpy(), slots["bits"].to_numpy().view(U64)))
    found = docs.mapInArrow(_seed_rows(width, mask_count, sizes, False, passing), schema.format(dict(docs.dtypes)["doc"]))
    a = mine.select("seed", F.col("rec").alias("item"), F.col("rest").alias("ir"))
    met = a.join(found.select("seed", F.col("rec").alias("doc"), "pos", "size", "rest"), "seed")
    same = F.aggregate(F.zip_with("ir", "rest", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    hits = met.select("item", "doc", "pos", "size", (F.col("size") - F.size("rest") + same).alias("equal"))
    return hits.where(F.col("equal") >= F.col("size") - max_substitutions)
