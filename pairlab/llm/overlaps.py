"""Evaluation texts that also occur in training data, exactly or almost.

Evaluation texts lie in shards of bounded size, each with a full-text index over words: the
Burrows-Wheeler transform of the shard, compressed by runs, searched backwards. Training
texts are streamed through the shards; the index intervals of word shingles give the exact similarity
to every text of the shard, and the maximal matches of each similar pair are merged into spans.

The index of all evaluation texts grows with the data, so it isn't sent to every worker, and
streaming all training text through every shard would cost training x shards. Sketch bands say
which shards a training text can match in, and it visits only those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut
from .near_duplicates import candidates, texts_of
from .sketches import CHARS_AT_ONCE, band_partitions, band_rows, word_hashes

#: Characters of evaluation text in a shard, about, and training texts that one task streams through it.
SHARD_CHARS, STREAM_TEXTS = 1_000_000, 20_000
#: Occurrences, and words of matched pairs, looked at at once by a worker.
_OCCURRENCES, _PAIR_WORDS = 2_000_000, 200_000


class WordIndex:
    """Backward search over the words of several texts."""

    def __init__(self, words: np.ndarray, text: np.ndarray, texts: int, shingle: int):
        self.vocabulary, coded = np.unique(words, return_inverse=True)
        # Every text ends in a mark of its own, above all words, so no match runs over an end.
        ends = np.searchsorted(text, np.arange(texts), "right")
        symbols = np.insert(coded.astype(np.int64), ends, len(self.vocabulary) + np.arange(texts))
        owner = np.insert(text.astype(np.int64), ends, np.arange(texts))
        n = self.n = len(symbols)
        self.symbols, self.bounds = symbols, np.r_[0, ends + np.arange(texts) + 1]
        order = self._suffixes(symbols)
        bwt = symbols[order - 1]
        # The transform is kept as runs of equal symbols, by symbol, then place; texts alike make long runs.
        start = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        length = np.diff(np.r_[start, n])
        key = bwt[start] * (n + 1) + start
        by_symbol = np.argsort(key)
        self.runs, self.run_length = key[by_symbol], length[by_symbol]
        self.before = np.cumsum(self.run_length) - self.run_length
        self.shingle, self.owner = shingle, owner[order]
        # Suffixes that start a shingle, and of those the first of each shingle in each text.
        heads = np.stack([symbols[np.minimum(order + k, n - 1)] for k in range(shingle)])
        whole = (heads < len(self.vocabulary)).all(axis=0) & (order + shingle <= n)
        group = np.cumsum(np.r_[True, (heads[:, 1:] != heads[:, :-1]).any(axis=0)])
        place = np.flatnonzero(whole)
        by = place[np.lexsort((place, self.owner[place], group[place]))]
        new = np.r_[True, (group[by][1:] != group[by][:-1]) | (self.owner[by][1:] != self.owner[by][:-1])] if len(by) else np.empty(0, bool)
        self.first = np.sort(by[new])
        self.sizes = np.bincount(self.owner[self.first], minlength=texts)

    @staticmethod
    def _suffixes(symbols: np.ndarray) -> np.ndarray:
        """Suffixes in order, by doubling the compared length."""
        n, length = len(symbols), 1
        rank = symbols
        while True:
            after = np.zeros(n, dtype=np.int64)
            after[: n - length] = rank[length:] + 1
            key = rank * (int(rank.max()) + 2) + after
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
            length *= 2
            if rank[order[-1]] == n - 1 or length >= n:
                return order

    def code(self, words: np.ndarray) -> np.ndarray:
        """Symbols of words; -1 where no text of the shard has the word."""
        if not len(self.vocabulary):
            return np.full(len(words), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, -1)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals one word further to the left; unknown words give empty ones."""
        base = symbol * (self.n + 1)
        lo, hi = self._rank(base + lo), self._rank(base + hi)
        return lo, np.where(symbol < 0, lo, hi)

    def _rank(self, key: np.ndarray) -> np.ndarray:
        """How many symbols of the transform are smaller, or are the same and come before the place; ``key`` is symbol and place."""
        at = np.searchsorted(self.runs, key) - 1
        # The run before a key may be of a smaller symbol: then it counts whole, as the key is beyond its end.
        return np.where(at < 0, 0, self.before[at] + np.minimum(self.run_length[at], key - self.runs[at]))

    def shingle_intervals(self, coded: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each shingle of the texts: first word's position and its interval."""
        n = len(coded) - self.shingle + 1
        if n <= 0:
            return (np.empty(0, np.int64),) * 3
        at = np.flatnonzero(text[:n] == text[self.shingle - 1 :])
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64)
        for k in reversed(range(self.shingle)):
            lo, hi = self.step(coded[at + k], lo, hi)
        return at, lo, np.maximum(lo, hi)

    def matches(self, coded: np.ndarray, start: np.ndarray, end: np.ndarray, evals: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All maximal matches of each stretch of words with its own text ``evals`` (without it, with any text of the
        shard): stretch, first word, end, in order. Those of one stretch may overlap, none lies in another.

        The pairs lie one after another with symbols of their own. Ranks by doubled length give the order of their
        suffixes; the longest match at a word is with the nearest suffix of the evaluation text before or after it."""
        if not len(start):
            return (np.empty(0, np.int64),) * 3
        lo = np.zeros(len(start), np.int64) if evals is None else self.bounds[evals]
        hi = np.full(len(start), self.n) if evals is None else self.bounds[evals + 1]
        own, other = hi - lo, end - start
        begin = np.cumsum(own + other + 1) - (own + other + 1)
        pair = np.repeat(np.arange(len(start)), own + other + 1)
        at = np.arange(len(pair)) - begin[pair]
        left = at < own[pair]
        inside = ~left & (at < (own + other)[pair])
        # Words that the shard lacks and the end of a stretch: a symbol that no evaluation text has.
        symbols = np.full(len(pair), len(self.vocabulary) + len(self.bounds), dtype=np.int64)
        symbols[left] = self.symbols[(lo[pair] + at)[left]]
        place = (start[pair] + at - own[pair])[inside]
        symbols[inside] = np.where(coded[place] < 0, symbols[inside], coded[place])
        ranks = [np.unique(pair * (len(self.vocabulary) + len(self.bounds) + 1) + symbols, return_inverse=True)[1]]
        while True:
            rank, length = ranks[-1], 1 << (len(ranks) - 1)
            known = np.zeros(int(rank.max()) + 1, dtype=bool)
            known[rank[left]] = True
            if not known[rank[inside]].any():
                break
            after = np.zeros(len(rank), dtype=np.int64)
            after[: len(rank) - length] = rank[length:] + 1
            ranks.append(np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1])
        order = np.argsort(ranks[-1], kind="stable")
        n, mine = len(order), left[order]
        before = np.maximum.accumulate(np.where(mine, np.arange(n), -1))
        behind = np.minimum.accumulate(np.where(mine, np.arange(n), n)[::-1])[::-1]
        longest = np.zeros(n, dtype=np.int64)
        for near in (before, behind):
            some = np.flatnonzero(~mine & (near >= 0) & (near < n))
            i, j = order[some], order[near[some]]
            same = np.zeros(len(some), dtype=np.int64)
            for k in reversed(range(len(ranks) - 1)):
                same += (ranks[k][i + same] == ranks[k][j + same]).astype(np.int64) << k
            longest[i] = np.maximum(longest[i], same)
        # A match lies in the one that starts a word earlier if that is longer by a word.
        first = np.flatnonzero((longest > 0) & (np.r_[0, longest[:-1]] <= longest))
        word = start[pair[first]] + at[first] - own[pair[first]]
        return pair[first], word, word + longest[first]


def merged(pair: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches, in order, with those that share words put together."""
    if not len(pair):
        return pair, first, stop
    new = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (first[1:] >= stop[:-1])])
    return pair[new], first[new], stop[np.r_[new[1:], len(pair)] - 1]


def _stream(shingle: int, least: float, span_words: int):
    names = ["e", "e2", "t", "t2", "shared", "total", "longest_span", "span_words", "spans"]
    part = pa.struct([("first", pa.int32()), ("stop", pa.int32())])

    def compare(index: WordIndex, tids: np.ndarray, stream: list[tuple[tuple[int, int], str]]) -> pa.RecordBatch | None:
        words, text = word_hashes([t for _, t in stream])
        count = len(stream)
        coded = index.code(words)
        at, lo, hi = index.shingle_intervals(coded, text)
        if not len(at):
            return None
        # Distinct shingles of a text: known ones by their interval, others by their words.
        known = hi > lo
        packed = np.zeros(len(at), dtype=np.uint64)
        for k in range(shingle):
            packed = packed * np.uint64(0x9E3779B97F4A7C15) + words[at + k]
        by = np.lexsort((packed, text[at]))
        new = np.r_[True, (packed[by][1:] != packed[by][:-1]) | (text[at][by][1:] != text[at][by][:-1])]
        once = by[new]
        size = np.bincount(text[at][once], minlength=count)
        once = once[known[once]]
        f, g = np.searchsorted(index.first, lo[once]), np.searchsorted(index.first, hi[once])
        found = []
        total = np.cumsum(g - f)
        for a, b in _slices(total, _OCCURRENCES):
            n = (g - f)[a:b]
            entry = np.repeat(f[a:b] - np.cumsum(n) + n, n) + np.arange(n.sum())
            found.append(np.unique(np.repeat(text[at][once][a:b], n) * len(tids) + index.owner[index.first[entry]], return_counts=True))
        if not found:
            return None
        pair, inverse = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
        shared = np.bincount(inverse, np.concatenate([c for _, c in found])).astype(np.int64)
        t, e = pair // len(tids), pair % len(tids)
        either = size[t] + index.sizes[e] - shared
        keep = np.flatnonzero(shared >= least * either - 1e-9)
        if not len(keep):
            return None
        t, e = t[keep], e[keep]
        start, end = np.searchsorted(text, t), np.searchsorted(text, t, "right")
        longest, covered, spans = np.zeros(len(keep), np.int64), np.zeros(len(keep), np.int64), []
        for a, b in _slices(np.cumsum(end - start + index.bounds[e + 1] - index.bounds[e]), _PAIR_WORDS):
            which, first, stop = index.matches(coded, start[a:b], end[a:b], e[a:b])
            np.maximum.at(longest, which + a, stop - first)
            long = stop - first >= span_words
            which, first, stop = merged(which[long] + a, first[long], stop[long])
            np.add.at(covered, which, stop - first)
            spans.append((which, first - start[which], stop - start[which]))
        which, first, stop = (np.concatenate(x) for x in zip(*spans))
        offsets = np.r_[0, np.cumsum(np.bincount(which, minlength=len(keep)))].astype(np.int32)
        places = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (first, stop)], fields=list(part))
        ids = np.array([i for i, _ in stream], dtype=np.int64).reshape(-1, 2)
        columns = [*tids[e].T, *ids[t].T, *(x.astype(np.int32) for x in (shared[keep], either[keep], longest, covered))]
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in columns), pa.ListArray.from_arrays(pa.array(offsets), places)], names=names)

    def _slices(total: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
        a = 0
        while a < len(total):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
            yield a, b
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index, tids, evals, stream, held, last = None, None, None, [], [], 0, None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("shard", "salt", "side", "tid", "tid2", "text")]
            for key0, key1, side, tid, tid2, text in zip(*cols):
                tid = (tid, tid2)
                if (key0, key1) != shard:
                    if stream and (out := compare(index, tids, stream)) is not None:
                        yield out
                    shard, index, evals, stream, held, last = (key0, key1), None, [], [], 0, None
                if (side, tid) == last:
                    continue
                last = (side, tid)
                if side == 0:
                    evals.append((tid, text))
                    continue
                if index is None:
                    if not evals:
                        continue
                    tids = np.array([i for i, _ in evals], dtype=np.int64).reshape(-1, 2)
                    index = WordIndex(*word_hashes([t for _, t in evals]), len(evals), shingle)
                stream.append((tid, text))
                held += len(text)
                if held >= CHARS_AT_ONCE // 2:
                    if (out := compare(index, tids, stream)) is not None:
                        yield out
                    stream, held = [], 0
        if stream and (out := compare(index, tids, stream)) is not None:
            yield out

    return run


def overlapping_texts(evaluation: DataFrame, training: DataFrame, least: float, shingle: int, bands: int, rows: int, partitions: int, span_words: int = 8) -> DataFrame:
    """``e``, ``e2``, ``t``, ``t2``, ``shared``, ``total``, ``longest_span``, ``span_words``, ``spans`` for the pairs of an evaluation
    and a training text (inputs and their two keys as from texts_of) with a similarity of ``least`` or more: shingles in both
    and in either, the longest run of words that both texts have, the training text's words in such runs of ``span_words`` or
    more, and these runs, put together where they share words (first word, and the one behind the last, of the training text's words from 0)."""
    sides = [band_rows(df, bands, rows, shingle, side) for side, df in enumerate((evaluation, training))]
    routes = cut(candidates(sides[0].unionByName(sides[1]), partitions, cross=True).select(F.col("a").alias("e"), F.col("b").alias("t")))
    wanted = routes.select(F.col("e").alias("tid")).distinct()
    # A row's text is no larger than its bands, about, so as many partitions do for both.
    moved = lambda df: df.select("tid", "tid2", "text").repartition(partitions, "tid")
    held = cut(moved(evaluation).join(wanted, "tid", "left_semi").groupBy("tid", "tid2").agg(F.min("text").alias("text")))
    chars = held.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    shards = max(1, -(-chars // SHARD_CHARS))
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards))
    visits = routes.select(shard("e").alias("shard"), F.col("t").alias("tid")).distinct()
    # A shard that many training texts visit is copied, so that no task streams more than its share.
    salts = visits.groupBy("shard").agg(F.ceil(F.count("*") / STREAM_TEXTS).cast("int").alias("salts"))
    visits = visits.join(salts, "shard").select("shard", F.pmod(F.xxhash64("tid"), "salts").cast("int").alias("salt"), F.lit(1).alias("side"), "tid")
    streamed = visits.join(moved(training), "tid")
    indexed = held.withColumn("shard", shard("tid")).join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"), "tid", "tid2", "text")
    both = indexed.unionByName(streamed.select("shard", "salt", "side", "tid", "tid2", "text"))
    placed = both.repartition(max(shards, int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "shard", "salt").sortWithinPartitions("shard", "salt", "side", "tid", "tid2")
    schema = "e long, e2 long, t long, t2 long, shared int, total int, longest_span int, span_words int, spans array<struct<first:int,stop:int>>"
    return placed.mapInArrow(_stream(shingle, least, span_words), schema).dropDuplicates(["e", "e2", "t", "t2"])


def overlaps(evaluation: DataFrame, training: DataFrame, fields: dict[str, tuple[str, str]], least: float = 0.8, shingle: int = 5, bands: int = 32, rows: int = 4) -> DataFrame:
    """``field``, ``eval_id``, ``train_id``, ``similarity``, ``longest_span``, ``span_words``, ``spans``: each record of ``evaluation`` with
    each record of ``training`` whose text has a similarity of ``least`` or more.

    ``fields``: name -> (id column, text column), in both tables; like fields are compared with like.
    Null and empty texts and texts of fewer than ``shingle`` words match nothing; repeated rows count
    once. A pair of similarity s is missed with probability (1 - s ** rows) ** bands.
    """
    e, t = texts_of(evaluation, fields), texts_of(training, fields)
    partitions = band_partitions(evaluation, len(fields) * bands) + band_partitions(training, len(fields) * bands)
    pairs = cut(overlapping_texts(e, t, least, shingle, bands, rows, partitions))
    ids = lambda df, name, key: df.select("field", F.col("id").alias(name), F.col("tid").alias(key), F.col("tid2").alias(f"{key}2")).distinct()
    named = pairs.join(ids(e, "eval_id", "e"), ["e", "e2"]).join(ids(t, "train_id", "t").drop("field"), ["t", "t2"])
    return named.select("field", "eval_id", "train_id", F.round(F.col("shared") / F.col("total"), 6).alias("similarity"), "longest_span", "span_words", "spans")
