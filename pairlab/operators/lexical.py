"""Term statistics and lexical scores in long form: one row for each document and term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams_1_2, tokens
from ..plans.cut import cut


def text_key(c: Column | str) -> Column:
    """What names a text in term statistics: its MD5, which is shorter than most texts."""
    return F.md5(F.col(c) if isinstance(c, str) else c)


def corpus(df: DataFrame, columns: list[str]) -> DataFrame:
    """``doc`` (its key), ``text``: the distinct texts of several columns; null counts as '', which is a document without terms."""
    out = None
    for c in columns:
        one = df.select(F.coalesce(F.col(c), F.lit("")).alias("text"))
        out = one if out is None else out.union(one)
    return out.distinct().select(text_key("text").alias("doc"), "text")


def term_counts(df: DataFrame, doc: str, text: str, bigrams: bool = False) -> DataFrame:
    """``doc``, ``term``, ``tf``. Documents without terms have no row."""
    toks = tokens(text)
    long = df.select(F.col(doc).alias("doc"), F.explode(ngrams_1_2(toks) if bigrams else toks).alias("term"))
    return long.groupBy("doc", "term").agg(F.count("*").alias("tf"))


def term_statistics(df: DataFrame, text: str, bigrams: bool = False) -> DataFrame:
    """``term``, ``df`` (rows that have it), ``total`` (its occurrences). A row is a document.

    A document's terms are sorted in its row, so a term's first occurrence shows there and the only shuffle is of sums by term."""
    toks = tokens(text)
    rows = df.select(F.sort_array(ngrams_1_2(toks) if bigrams else toks).alias("t"))
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), F.col("t")), F.lit(1), F.size("t"))
    long = rows.select("t", before.alias("b")).select(F.explode(F.arrays_zip("t", "b")).alias("x"))
    first = (F.col("x.b").isNull() | (F.col("x.t") != F.col("x.b"))).cast("long")
    return long.groupBy(F.col("x.t").alias("term")).agg(F.sum(first).alias("df"), F.count("*").alias("total"))


def vocabulary(stats: DataFrame, min_df: int = 2, size: int = 200_000) -> DataFrame:
    """``term``, ``df``, ``total`` (as from term_statistics) of terms in ``min_df`` documents or more; of these the ``size`` with the
    most occurrences, then by code points."""
    return stats.where(F.col("df") >= min_df).orderBy(F.desc("total"), "term").limit(size)


def tfidf(counts: DataFrame, vocab: DataFrame, documents: Column | int) -> DataFrame:
    """``doc``, ``term``, ``w``: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), each document to unit length.
    ``vocab`` is of vocabulary(), whose size bounds what is broadcast.

    The norm comes from an aggregation by document, joined back, rather than a window.
    """
    n = F.lit(documents) if isinstance(documents, int) else documents
    # A vocabulary has a stated size, and its frequent terms are in every document: broadcast, no shuffle by term.
    raw = counts.join(F.broadcast(vocab), "term").select("doc", "term", ((1 + F.log("tf")) * (F.log((1 + n) / (1 + F.col("df"))) + 1)).alias("w"))
    size = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("__z"))
    return raw.join(size, "doc").select("doc", "term", (F.col("w") / F.col("__z")).alias("w"))


def pair_dot(pairs: DataFrame, pair: str, a: str, b: str, weights_a: DataFrame, weights_b: DataFrame) -> DataFrame:
    """``pair``, ``score``: the dot product of each pair's documents; 0 for pairs without a common term."""
    left = pairs.select(pair, F.col(a).alias("doc")).join(weights_a, "doc").select(pair, "term", F.col("w").alias("__a"))
    right = pairs.select(pair, F.col(b).alias("doc")).join(weights_b, "doc").select(pair, "term", F.col("w").alias("__b"))
    common = left.join(right, [pair, "term"]).groupBy(pair).agg(F.sum(F.col("__a") * F.col("__b")).alias("score"))
    return pairs.select(pair).join(common, pair, "left").select(pair, F.coalesce("score", F.lit(0.0)).alias("score"))


def bm25(pairs: DataFrame, pair: str, query_terms: DataFrame, doc_terms: DataFrame, train_stats: DataFrame, documents: int, k1: float = 1.5, b: float = 0.75, min_df: int = 2, size: int = 200_000) -> DataFrame:
    """``pair``, ``score``: BM25 with binary query terms.

    ``query_terms``: pair, term. ``doc_terms``: pair, term, tf. ``train_stats``: term_statistics of the passages that give
    vocabulary (as in vocabulary()), document frequencies and mean length; ``documents`` is their number, empty ones
    included. Lengths count terms of the vocabulary only; idf is ln(1 + (n - df + 0.5) / (df + 0.5)). Pairs
    without a common term score 0.
    """
    kept = cut(vocabulary(train_stats, min_df, size))
    stats = F.broadcast(kept.select("term", "df"))
    mean = kept.agg(F.greatest(F.sum("total") / F.lit(documents), F.lit(1e-12)).alias("__avg"))
    known = doc_terms.join(stats, "term")
    length = known.groupBy(pair).agg(F.sum("tf").alias("__len"))
    idf = F.log(1 + (F.lit(documents) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    hit = known.join(query_terms.select(pair, "term").distinct(), [pair, "term"]).join(length, pair).crossJoin(F.broadcast(mean))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("__len") / F.col("__avg")))
    score = hit.groupBy(pair).agg(F.sum(part).alias("score"))
    return pairs.select(pair).join(score, pair, "left").select(pair, F.coalesce("score", F.lit(0.0)).alias("score"))


def pair_features(query: Column | str, passage: Column | str) -> dict[str, Column]:
    """Token Jaccard, share of the claim's tokens in the passage, log length and log length ratio of a pair of texts."""
    a, b = F.array_distinct(tokens(query)), F.array_distinct(tokens(passage))
    both = F.size(F.array_intersect(a, b))
    na, nb = F.size(tokens(query)), F.size(tokens(passage))
    return {
        "token_jaccard": F.coalesce(both / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0)),
        "claim_coverage": F.coalesce(both / F.nullif(F.size(a), F.lit(0)), F.lit(0.0)),
        "log1p_passage_length": F.log1p(nb),
        "log1p_passage_claim_ratio": F.log1p(F.coalesce(nb / F.nullif(na, F.lit(0)), F.lit(0.0))),
    }
