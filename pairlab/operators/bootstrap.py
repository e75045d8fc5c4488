"""ROC-AUC of bootstrap replicates by weight vectors.

A query's weights in all replicates are one vector, so rows move once, whatever the number of replicates: equal scores
are summed where they lie, sums are range-partitioned by score, each partition counts its own pairs for all
replicates at once, and a partition adds what lies below it. Counts are whole numbers, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hex_number

#: Rows handled at once by a worker.
_ROWS = 500


def weight_vectors(queries: DataFrame, query: str, replicates: int, seed: int, within: str | None = None) -> DataFrame:
    """``query`` (and ``within``), ``w``: for each numbered query (see resample.numbered_queries) how often each replicate draws it,
    as a BINARY of 16-bit numbers. The draws are those of resample.weights; a query that is never drawn has no row."""
    keys = [within] if within else []
    parts = [F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("replicate").cast("string"), F.col("i").cast("string")]
    each = queries.select(*keys, "i", "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    draws = each.select(*keys, (hex_number(F.md5(F.concat_ws("|", *parts)), 12) % F.col("n")).alias("i"), "replicate")
    # About as many draws for a query as replicates.
    drawn = draws.groupBy(*keys, "i").agg(F.collect_list("replicate").alias("draws"))
    named = drawn.join(queries.select(*keys, "i", query), [*keys, "i"]).select(*keys, query, "draws")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                part = batch.slice(a, _ROWS)
                lists = part.column(part.num_columns - 1)
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                w = np.bincount(row * replicates + lists.flatten().to_numpy(zero_copy_only=False), minlength=len(lists) * replicates).astype("<u2").reshape(len(lists), replicates)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([x.tobytes() for x in w], pa.binary())], names=[*keys, query, "w"])

    kinds = dict(named.dtypes)
    return named.mapInArrow(count, ", ".join(f"{c} {kinds[c]}" for c in [*keys, query]) + ", w binary")


def _matrix(column: pa.Array, kind: str, replicates: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, replicates).astype(np.int64)


def _summed(replicates: int):
    """Weights of positives and negatives for each system and score of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                part = batch.slice(a, _ROWS)
                keys = pd.DataFrame({c: part.column(c).to_pandas() for c in ("system", "score", "positive")})
                group = keys.groupby(["system", "score", "positive"], sort=True).ngroup().to_numpy()
                order = np.argsort(group, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0])
                sums = np.add.reduceat(_matrix(part.column("w"), "<u2", replicates)[order], starts, axis=0).astype("<i4")
                first = part.select(["system", "score", "positive"]).take(pa.array(order[starts]))
                yield pa.RecordBatch.from_arrays([*first.columns, pa.array([x.tobytes() for x in sums], pa.binary())], names=["system", "score", "positive", "w"])

    return run


def _counted(replicates: int):
    """For each system of a partition, in the order of scores: twice its pairs in order (ties half), and the weight of both classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero = lambda: np.zeros(replicates, np.int64)
        system, first, score, below, pos, neg, pairs, p, q = None, None, None, *(zero() for _ in range(6))

        def close():
            nonlocal pairs, pos, neg, below, p, q
            pairs, pos, neg, below, p, q = pairs + p * (2 * below + q), pos + p, neg + q, below + q, zero(), zero()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([system]), pa.array([first], pa.float64()), *(pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (pairs, pos, neg))], names=["system", "first", "pairs", "pos", "neg"])

        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                part = batch.slice(a, _ROWS)
                w = _matrix(part.column("w"), "<i4", replicates)
                for i, (s, v, y) in enumerate(zip(*(part.column(c).to_pylist() for c in ("system", "score", "positive")))):
                    if s != system:
                        if system is not None:
                            close()
                            yield out()
                        system, first, score = s, v, v
                        below, pos, neg, pairs, p, q = (zero() for _ in range(6))
                    elif v != score:
                        close()
                        score = v
                    if y:
                        p = p + w[i]
                    else:
                        q = q + w[i]
        if system is not None:
            close()
            yield out()

    return run


def _combined(replicates: int):
    def run(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("first", kind="stable")
        pairs, pos, neg = (np.stack([np.frombuffer(x, "<i8") for x in parts[c]]) for c in ("pairs", "pos", "neg"))
        before = np.cumsum(neg, axis=0) - neg
        total = (pairs + 2 * pos * before).sum(axis=0)
        n = 2.0 * pos.sum(axis=0) * neg.sum(axis=0)
        value = pd.Series(total / np.where(n > 0, n, 1), dtype="Float64").where(n > 0)
        return pd.DataFrame({"system": parts["system"].iloc[0], "replicate": np.arange(replicates, dtype=np.int32), "value": value})

    return run


def replicate_auc(rows: DataFrame, by: Sequence[str], query: str, positive: Column, score: str, weights: DataFrame, replicates: int, within: str | None = None) -> DataFrame:
    """``by``, ``replicate``, ``value``: ROC-AUC (ties half) of each group in each replicate, null where a class is missing.

    ``weights``: as from weight_vectors; rows whose query has no weight, or a null or NaN score, or a null class, take no part. A group
    without any row has no result. Groups (systems, seeds, bins) share the draws of their queries.
    """
    system = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("system")
    s = F.col(score).cast("double")
    kept = rows.where(s.isNotNull() & ~F.isnan(s) & positive.isNotNull())
    keys = [*([within] if within else []), query]
    drawn = kept.select(*keys, system, s.alias("score"), positive.alias("positive")).join(weights, keys).select("system", "score", "positive", "w")
    schema = "system string, score double, positive boolean, w binary"
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = drawn.mapInArrow(_summed(replicates), schema)
    ranged = sums.repartitionByRange(n, "system", "score").sortWithinPartitions("system", "score")
    parts = ranged.mapInArrow(_counted(replicates), "system string, first double, pairs binary, pos binary, neg binary")
    # One row for each system and partition at most.
    values = parts.groupBy("system").applyInPandas(_combined(replicates), "system string, replicate int, value double")
    kinds = dict(rows.dtypes)
    told = F.from_json("system", ", ".join(f"`{c}` {kinds[c]}" for c in by)).alias("k")
    return values.select(told, "replicate", "value").select(*[F.col("k")[c].alias(c) for c in by], "replicate", "value")


def replicate_sums(rows: DataFrame, by: Sequence[str], query: str, cells: dict[str, Column], weights: DataFrame, replicates: int, within: str | None = None) -> DataFrame:
    """``by``, ``replicate`` and for each of ``cells`` the weighted sum of its values, null counting as 0: what accuracy, F1 and means
    over queries are made of. A group without any row that is drawn has no result."""
    system = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("system")
    keys, names = [*([within] if within else []), query], list(cells)
    values = F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in cells.values()]).alias("values")
    drawn = rows.select(*keys, system, values).join(weights, keys).select("system", "values", "w")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                part = batch.slice(a, _ROWS)
                w = _matrix(part.column("w"), "<u2", replicates).astype(float)
                v = part.column("values").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names))
                of = part.column("system").to_pandas()
                for name, at in of.groupby(of).indices.items():
                    held[name] = held.get(name, 0.0) + v[at].T @ w[at]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([x.astype("<f8").tobytes() for x in held.values()], pa.binary())], names=["system", "sums"])

    def told(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<f8").reshape(len(names), replicates) for x in parts["sums"])
        return pd.DataFrame({"system": parts["system"].iloc[0], "replicate": np.arange(replicates, dtype=np.int32)} | dict(zip(names, total)))

    # One row for each system and task.
    sums = drawn.mapInArrow(add, "system string, sums binary").groupBy("system").applyInPandas(told, "system string, replicate int, " + ", ".join(f"`{c}` double" for c in names))
    kinds = dict(rows.dtypes)
    k = F.from_json("system", ", ".join(f"`{c}` {kinds[c]}" for c in by)).alias("k")
    return sums.select(k, "replicate", *names).select(*[F.col("k")[c].alias(c) for c in by], "replicate", *names)


def replicate_f1(rows: DataFrame, by: Sequence[str], query: str, label: str, predicted: str, weights: DataFrame, replicates: int, classes: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """``by``, ``replicate``, ``accuracy``, ``macro_f1`` (0 for a class without any row) over the fixed ``classes``; null where nothing is drawn."""
    y, p = F.col(label), F.col(predicted)
    cells = {"ok": (y == p).cast("int"), "n": F.lit(1)}
    for c in classes:
        cells |= {f"tp{c}": ((y == c) & (p == c)).cast("int"), f"miss{c}": ((y == c) != (p == c)).cast("int")}
    s = replicate_sums(rows.where(y.isNotNull() & p.isNotNull()), by, query, cells, weights, replicates)
    f1 = [F.coalesce(2 * F.col(f"tp{c}") / F.nullif(2 * F.col(f"tp{c}") + F.col(f"miss{c}"), F.lit(0.0)), F.lit(0.0)) for c in classes]
    some = F.nullif("n", F.lit(0.0))
    return s.select(*by, "replicate", (F.col("ok") / some).alias("accuracy"), F.when(F.col("n") > 0, sum(f1, F.lit(0.0)) / len(classes)).alias("macro_f1"))


def replicate_mean(values: DataFrame, by: Sequence[str], query: str, value: str, weights: DataFrame, replicates: int) -> DataFrame:
    """``by``, ``replicate``, ``value``: the mean of the drawn queries' values; null and NaN don't count."""
    v = F.col(value)
    s = replicate_sums(values.where(v.isNotNull() & ~F.isnan(v)), by, query, {"s": v, "n": F.lit(1)}, weights, replicates)
    return s.select(*by, "replicate", (F.col("s") / F.nullif("n", F.lit(0.0))).alias("value"))
