"""Classifiers over tasks, models and seeds, trained on a bounded sample of labelled rows and applied to all rows.

A model is a feature map of a pair of texts with softmax regression on top (cross entropy; with two classes that is
binary cross entropy). Each (task, model, seed) is trained in a task of its own; the seed orders the rows and sets
the first weights. The weights, a few hundred numbers each, are what is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut
from .adapters import hashed_terms
from .lexical import pair_features

#: Rows of a task that a model is trained on, at most; all rows are scored.
SAMPLE = 20_000


def featured(df: DataFrame, query: str, passage: str, keep: Sequence[str], size: int = 64) -> DataFrame:
    """``keep``, ``lexical`` (lengths and overlaps of the pair) and ``hashed`` (products of both texts' unit vectors of hashed words)."""
    rows = df.select(*keep, F.coalesce(query, F.lit("")).alias("__q"), F.coalesce(passage, F.lit("")).alias("__p"), F.array(*pair_features(query, passage).values()).alias("lexical"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = hashed_terms(size)()
        for batch in batches:
            q, p = (encode(batch.column(c).to_pylist()) for c in ("__q", "__p"))
            unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            both = pa.array((unit(q) * unit(p) * size).tolist(), pa.list_(pa.float64()))
            kept = batch.select([*keep, "lexical"])
            yield pa.RecordBatch.from_arrays([*kept.columns, both], names=[*keep, "lexical", "hashed"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(add, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lexical array<double>, hashed array<double>")


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, seed: int, epochs: int = 20, rate: float = 0.1, l2: float = 1e-4, batch: int = 256) -> np.ndarray:
    """Weights (features + 1, classes) of softmax regression on standardized features by gradient steps in a seeded order; the
    standardization is part of the weights."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = rng.normal(0, 0.01, (z.shape[1], classes))
    target = np.eye(classes)[y]
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(z)), max(1, len(z) // batch)):
            p = softmax(z[part] @ w)
            w -= rate / (1 + epoch) * (z[part].T @ (p - target[part]) / len(part) + l2 * w)
    out = w.copy()
    out[:-1] /= scale[:, None]
    out[-1] -= (mean / scale) @ w[:-1]
    return out


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train_grid(train: DataFrame, task: str, label: str, models: Sequence[str], seeds: Sequence[int], order: str, sample: int = SAMPLE) -> DataFrame:
    """``task``, ``model``, ``seed``, ``classes``, ``rows`` (trained on), ``weights``: a classifier for each task, feature column and seed.

    ``train``: one row for each task and record with its class from 0. Of a task with more than about ``sample`` rows those with
    the least hash of ``order`` are taken, by a threshold, so no rows are sorted. A task without rows has no model."""
    sizes = train.groupBy(task).agg(F.count("*").alias("__n"), (F.max(label) + 1).alias("classes"))
    share = F.lit(float(sample)) / F.col("__n")
    hashed = F.pmod(F.xxhash64(F.col(order).cast("string")), F.lit(1_000_000)) / F.lit(1e6)
    taken = train.join(sizes, task).where(hashed < share)
    grid = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(s).alias("seed"), F.col(m).alias("x")) for m in models for s in seeds])).alias("g")
    rows = taken.select(F.col(task).alias("task"), F.col(label).cast("int").alias("y"), F.col("classes").cast("int").alias("classes"), F.col(order).cast("string").alias("o"), grid).select("task", "y", "classes", "o", "g.*")

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("o", kind="stable")
        classes = int(part["classes"].iloc[0])
        w = fit_softmax(np.array(part["x"].tolist(), dtype=float), part["y"].to_numpy(), classes, int(key[2]))
        return pd.DataFrame({"task": [key[0]], "model": [key[1]], "seed": [int(key[2])], "classes": [classes], "rows": [len(part)], "weights": [w.reshape(-1).tolist()]})

    return rows.groupBy("task", "model", "seed").applyInPandas(fit, "task string, model string, seed int, classes int, rows long, weights array<double>")


def score_grid(rows: DataFrame, fitted: DataFrame, models: Sequence[str], id_col: str) -> DataFrame:
    """``id_col``, ``task``, ``model``, ``seed``, ``probabilities`` of each row and fitted classifier, in one pass over the rows."""
    # One row for each task, model and seed.
    told = [(r.task, r.model, r.seed, np.array(r.weights).reshape(-1, r.classes)) for r in cut(fitted).collect()]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {m: np.array(batch.column(m).to_pylist(), dtype=float) for m in models}
            for task, model, seed, w in told:
                p = softmax(x[model] @ w[:-1] + w[-1])
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([task] * n), pa.array([model] * n), pa.array(np.full(n, seed, np.int32)), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["id", "task", "model", "seed", "probabilities"])

    source = rows.select(F.col(id_col).alias("id"), *models)
    return source.mapInArrow(score, f"id {dict(source.dtypes)['id']}, task string, model string, seed int, probabilities array<double>").withColumnRenamed("id", id_col)
