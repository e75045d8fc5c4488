"""Places where models plug in. A model is a function of plain Python values that workers load; none is shipped."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..plans.cut import cut
from .vectors import unit


def score_pairs(df: DataFrame, id_col: str, query: str, passage: str, load: Callable[[], Callable[[list[str], list[str]], Sequence[float]]], batch: int = 256) -> DataFrame:
    """``id_col``, ``score``: a model's score of each pair, in batches; null texts count as ''.

    ``load`` makes the scorer once in each task. A batch for which it runs out of memory is halved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = load()

        def scored(a: list[str], b: list[str]) -> list[float]:
            try:
                return [float(x) for x in score(a, b)]
            except MemoryError:
                if len(a) == 1:
                    raise
                h = len(a) // 2
                return scored(a[:h], b[:h]) + scored(a[h:], b[h:])

        for rb in batches:
            a, b = ([x or "" for x in rb.column(i).to_pylist()] for i in (1, 2))
            out = [s for k in range(0, len(a), batch) for s in scored(a[k : k + batch], b[k : k + batch])]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(out, pa.float64())], names=["id", "score"])

    source = df.select(F.col(id_col).alias("id"), query, passage)
    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, score double").withColumnRenamed("id", id_col)


def embed_distinct(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """``df`` with ``vector``: the unit vector of its text. Each distinct text is encoded once; null and empty texts get null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for rb in batches:
            m = np.asarray(encode(rb.column(0).to_pylist()), dtype=np.float64)
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(m.tolist(), pa.list_(pa.float64()))], names=["__t", "vector"])

    distinct = df.where(F.col(text) != "").select(F.col(text).alias("__t")).distinct()
    vectors = distinct.mapInArrow(run, "__t string, vector array<double>")
    return df.join(vectors, df[text] == vectors["__t"], "left").drop("__t")


def hashed_terms(size: int):
    """An encoder without a model: counts of hashed words."""

    def load():
        def encode(texts: list[str]) -> np.ndarray:
            m = np.zeros((len(texts), size))
            for i, t in enumerate(texts):
                for w in re.findall(r"[^\W_]+", t.lower()):
                    m[i, int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % size] += 1
            return m

        return encode

    return load


def overlap_model():
    """A pair scorer without a model: the Jaccard similarity of the words."""

    def score(a: list[str], b: list[str]) -> list[float]:
        out = []
        for x, y in zip(a, b):
            x, y = (set(re.findall(r"[^\W_]+", t.lower())) for t in (x, y))
            out.append(len(x & y) / max(1, len(x | y)))
        return out

    return score


def round_bf16(c: Column) -> Column:
    """A number with 8 significant bits, as a bfloat16 keeps it; ties to even."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(c))) - 7)
    return F.when(c == 0, F.lit(0.0)).otherwise(F.bround(c / step) * step)


def pool_first(states: Column, bf16: bool = False) -> Column:
    """The first token's state of a list of states (as a model gives them for [CLS]), to unit length; null for a zero state."""
    first = F.get(states, F.lit(0))
    first = F.transform(first, lambda x: round_bf16(x.cast("double"))) if bf16 else first
    return unit(first)


def next_token_probability(logits: Column, wanted: int, others: Sequence[int]) -> Column:
    """The probability of token ``wanted`` among it and ``others``, from a row's next-token logits."""
    at = lambda i: F.get(logits, F.lit(i)).cast("double")
    top = F.greatest(*[at(i) for i in (wanted, *others)]) if others else at(wanted)
    return F.exp(at(wanted) - top) / sum((F.exp(at(i) - top) for i in (wanted, *others)), F.lit(0.0))


def verbalize(logits: Column, words: dict[str, Sequence[int]]) -> dict[str, Column]:
    """Probability of each label from next-token logits: a label's score is the summed probability of its words' tokens, and
    scores are brought to a sum of 1 over the labels."""
    top = F.array_max(logits).cast("double")
    mass = {k: sum((F.exp(F.get(logits, F.lit(i)).cast("double") - top) for i in ids), F.lit(0.0)) for k, ids in words.items()}
    total = sum(mass.values(), F.lit(0.0))
    return {k: m / total for k, m in mass.items()}


def train_text_classifier(train: DataFrame, test: DataFrame, text: Column, label: str, id_col: str, keep: Sequence[str] = (), size: int = 200_000, min_df: int = 2) -> tuple[DataFrame, DataFrame]:
    """Logistic regression on TF-IDF of the words that ``min_df`` training texts have, the ``size`` most frequent of these:
    ``id_col``, kept columns and ``score`` of the test rows; and ``term``, ``coefficient`` of the vocabulary."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer
    from pyspark.ml.functions import vector_to_array

    steps = [CountVectorizer(inputCol="__w", outputCol="__tf", vocabSize=size, minDF=float(min_df)), IDF(inputCol="__tf", outputCol="__v"), LogisticRegression(featuresCol="__v", labelCol=label, maxIter=20, regParam=0.01)]
    words = lambda df: df.select(id_col, *{label, *keep}, tokens(text).alias("__w"))
    held = cut(words(train))
    model = Pipeline(stages=steps).fit(held)
    scores = model.transform(words(test)).select(id_col, *keep, vector_to_array("probability")[1].alias("score"))
    # The vocabulary has a stated size.
    terms = pd.DataFrame({"term": model.stages[0].vocabulary, "coefficient": model.stages[2].coefficients.toArray()})
    return scores, train.sparkSession.createDataFrame(terms)
