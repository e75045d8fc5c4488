"""Metrics of scored rows. All take long tables and group keys and return
the keys, ``metric`` and ``value``, so points, subsets, seeds and bootstrap replicates share one path.

Undefined values are null, never NaN; rows with a null score or label take no part. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.sequence import running


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _named(df: DataFrame, by: Sequence[str], **values: Column) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in values.items()]))
    return df.select(*by, pairs.alias("__x")).select(*by, "__x.metric", "__x.value")


def _div(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def accuracy_f1(df: DataFrame, by: Sequence[str], label: str, predicted: str, classes: Sequence[int] = (0, 1, 2), weight: Column | str | None = None) -> DataFrame:
    """accuracy, f1_<class> (0 without any row of the class) and macro_f1 over the fixed ``classes``, in one pass."""
    w = _c(weight) if weight is not None else F.lit(1)
    y, p = F.col(label), F.col(predicted)
    rows = df.where(y.isNotNull() & p.isNotNull())
    cells = [F.sum(F.when(y == p, w).otherwise(0)).alias("__ok"), F.sum(w).alias("__n")]
    for c in classes:
        cells += [F.sum(F.when((y == c) & (p == c), w).otherwise(0)).alias(f"__tp{c}"), F.sum(F.when((y == c) != (p == c), w).otherwise(0)).alias(f"__miss{c}")]
    agg = rows.groupBy(*by).agg(*cells)
    f1 = {c: F.coalesce(_div(2.0 * F.col(f"__tp{c}"), 2 * F.col(f"__tp{c}") + F.col(f"__miss{c}")), F.lit(0.0)) for c in classes}
    total = sum(f1.values(), F.lit(0.0))
    return _named(agg.where("__n > 0"), by, accuracy=F.col("__ok") / F.col("__n"), **{f"f1_{c}": v for c, v in f1.items()}, macro_f1=total / len(classes))


def _by_score(df: DataFrame, by: Sequence[str], positive: Column, score: Column | str, weight: Column | str | None) -> DataFrame:
    """Weight of positives and negatives for each distinct score of a group."""
    w = _c(weight) if weight is not None else F.lit(1)
    s = _c(score)
    kept = df.where(s.isNotNull() & ~F.isnan(s) & positive.isNotNull())
    return kept.groupBy(*by, s.alias("__s")).agg(F.sum(F.when(positive, w).otherwise(0)).alias("__p"), F.sum(F.when(positive, 0).otherwise(w)).alias("__q"))


def roc_auc(df: DataFrame, by: Sequence[str], positive: Column, score: Column | str, weight: Column | str | None = None, name: str = "roc_auc") -> DataFrame:
    """Area under the ROC curve, ties half; null where a class is missing. ``weight``: a row's multiplicity.
    Of many replicates see bootstrap.replicate_auc."""
    scores = _by_score(df, by, positive, score, weight)
    run = running(scores, by, [F.col("__s")], {"__below": "__q"})
    agg = run.groupBy(*by).agg(F.sum(F.col("__p") * (F.col("__below") + 0.5 * F.col("__q"))).alias("__a"), F.sum("__p").alias("__np"), F.sum("__q").alias("__nq"))
    return _named(agg, by, **{name: _div(F.col("__a"), F.col("__np") * F.col("__nq"))})


def macro_roc_auc(df: DataFrame, by: Sequence[str], query: str, positive: Column, score: Column | str, weight: Column | str | None = None) -> DataFrame:
    """ROC-AUC in which the positives of a query weigh 1 together, and each negative 1."""
    sizes = df.groupBy(*by, query).agg(F.count_if(positive).alias("__n"))
    counted = df.join(sizes, [*by, query])
    share = F.when(positive, F.lit(1.0) / F.col("__n")).otherwise(1.0)
    return roc_auc(counted, by, positive, score, share if weight is None else share * _c(weight), "macro_roc_auc")


def average_precision(df: DataFrame, by: Sequence[str], positive: Column, score: Column | str, weight: Column | str | None = None) -> DataFrame:
    """Average precision by steps: rows with the same score are one step. Null without positives."""
    scores = _by_score(df, by, positive, score, weight)
    run = running(scores, by, [-F.col("__s")], {"__tp": "__p", "__fp": "__q"})
    tp, seen = F.col("__tp") + F.col("__p"), F.col("__tp") + F.col("__p") + F.col("__fp") + F.col("__q")
    agg = run.groupBy(*by).agg(F.sum(F.col("__p") * _div(tp * 1.0, seen)).alias("__a"), F.sum("__p").alias("__np"))
    return _named(agg, by, average_precision=_div(F.col("__a"), F.col("__np")))


def average_precision_rowwise(df: DataFrame, by: Sequence[str], positive: Column, score: str, order: str) -> DataFrame:
    """Average precision row by row; rows with the same score come in ``order``. Null without positives."""
    rows = df.where(F.col(score).isNotNull()).select(*by, positive.cast("int").alias("__y"), (-F.col(score)).alias("__s"), F.col(order).alias("__o"))
    ranked = running(rows, by, ["__s", "__o"], {"__r": None, "__tp": "__y"})
    agg = ranked.groupBy(*by).agg(F.sum(F.when(F.col("__y") == 1, (F.col("__tp") + 1) / (F.col("__r") + 1))).alias("__a"), F.sum("__y").alias("__np"))
    return _named(agg, by, average_precision_rowwise=_div(F.col("__a"), F.col("__np")))


def pairwise_by_query(df: DataFrame, by: Sequence[str], query: str, better: Column, worse: Column, score: Column | str) -> DataFrame:
    """``by``, ``query``, ``value``: how often a row that is ``better`` has the larger score than one that is ``worse``, ties half.

    Taken from sums over the query's sorted scores, so no pairs are formed. Queries that lack one kind are left out.
    """
    rows = df.where(better | worse)
    scores = _by_score(rows, [*by, query], better, score, None)
    run = running(scores, [*by, query], [F.col("__s")], {"__below": "__q"})
    agg = run.groupBy(*by, query).agg(F.sum(F.col("__p") * (F.col("__below") + 0.5 * F.col("__q"))).alias("__a"), (F.sum("__p") * F.sum("__q")).alias("__n"))
    return agg.where("__n > 0").select(*by, query, (F.col("__a") / F.col("__n")).alias("value"))


def single_pairwise(df: DataFrame, by: Sequence[str], query: str, better: Column, worse: Column, score: str) -> DataFrame:
    """As pairwise_by_query for queries with one ``worse`` row: a lookup of its score, no sort."""
    one = df.where(worse).groupBy(*by, query).agg(F.max(score).alias("__w"), F.count("*").alias("__k")).where("__k = 1")
    value = F.when(F.col(score) > F.col("__w"), 1.0).when(F.col(score) == F.col("__w"), 0.5).otherwise(0.0)
    return df.where(better).join(one, [*by, query]).groupBy(*by, query).agg(F.avg(value).alias("value"))


def reciprocal_rank_by_query(df: DataFrame, by: Sequence[str], query: str, relevant: Column, score: str, order: str) -> DataFrame:
    """``by``, ``query``, ``value``: 1 / rank of the first relevant row; equal scores come in ``order``."""
    rows = df.where(F.col(score).isNotNull()).select(*by, query, relevant.alias("__y"), (-F.col(score)).alias("__s"), F.col(order).alias("__o"))
    ranked = running(rows, [*by, query], ["__s", "__o"], {"__r": None})
    return ranked.where("__y").groupBy(*by, query).agg((F.lit(1.0) / (F.min("__r") + 1)).alias("value"))


def ndcg_by_query(df: DataFrame, by: Sequence[str], query: str, grade: Column, score: str, order: str) -> DataFrame:
    """``by``, ``query``, ``value``: NDCG with gain 2 ** grade - 1; equal scores come in ``order``. Queries without a gain are left out."""
    keys = [*by, query]
    rows = df.where(F.col(score).isNotNull()).select(*keys, (F.pow(F.lit(2.0), grade) - 1).alias("__g"), (-F.col(score)).alias("__s"), F.col(order).alias("__o"))
    given = running(rows, keys, ["__s", "__o"], {"__r": None}).groupBy(*keys).agg(F.sum(F.col("__g") / F.log2(F.col("__r") + 2.0)).alias("__d"))
    ideal = running(rows.withColumn("__s", -F.col("__g")), keys, ["__s", "__o"], {"__r": None}).groupBy(*keys).agg(F.sum(F.col("__g") / F.log2(F.col("__r") + 2.0)).alias("__i"))
    return given.join(ideal, keys).where("__i > 0").select(*keys, (F.col("__d") / F.col("__i")).alias("value"))


def ndcg_linear_by_query(df: DataFrame, by: Sequence[str], query: str, grade: Column, score: str) -> DataFrame:
    """``by``, ``query``, ``value``: NDCG with the grade as gain; equal scores share the mean gain of their places."""
    keys = [*by, query]
    rows = df.where(F.col(score).isNotNull()).select(*keys, grade.cast("double").alias("__g"), F.col(score).alias("__s"))

    def gain(value: Column) -> DataFrame:
        groups = rows.groupBy(*keys, value.alias("__v")).agg(F.avg("__g").alias("__m"), F.count("*").alias("__n"))
        run = running(groups, keys, [("__v", "desc")], {"__before": "__n"})
        places = F.sequence(F.col("__before") + 1, F.col("__before") + F.col("__n"))
        discount = F.aggregate(F.transform(places, lambda r: F.lit(1.0) / F.log2(r + 1.0)), F.lit(0.0), lambda a, x: a + x)
        return run.groupBy(*keys).agg(F.sum(F.col("__m") * discount).alias("__t"))

    ideal = gain(F.col("__g")).withColumnRenamed("__t", "__i")
    return gain(F.col("__s")).join(ideal, keys).where("__i > 0").select(*keys, (F.col("__t") / F.col("__i")).alias("value"))


def mean_of_queries(df: DataFrame, by: Sequence[str], name: str, weight: str | None = None) -> DataFrame:
    """The mean of the queries' ``value``, weighted if asked for; null and NaN don't count."""
    v = df.where(F.col("value").isNotNull() & ~F.isnan("value"))
    agg = v.groupBy(*by).agg((F.avg("value") if weight is None else _div(F.sum(F.col("value") * F.col(weight)), F.sum(weight))).alias("__m"))
    return _named(agg, by, **{name: F.col("__m")})


def mean_score_by_class(df: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    agg = df.groupBy(*by).agg(*[F.avg(F.when(F.col(label) == k, F.col(score))).alias(f"__{n}") for k, n in ((0, "a"), (1, "x"), (2, "u"))])
    return _named(agg, by, mean_a=F.col("__a"), mean_x=F.col("__x"), mean_u=F.col("__u"))


def agreement(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """mae, max_abs, mean_difference and correlation of two score columns."""
    d = F.col(a) - F.col(b)
    agg = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by).agg(F.avg(F.abs(d)).alias("__m"), F.max(F.abs(d)).alias("__x"), F.avg(d).alias("__d"), F.corr(a, b).alias("__c"))
    return _named(agg, by, mae=F.col("__m"), max_abs=F.col("__x"), mean_difference=F.col("__d"), correlation=F.col("__c"))


def ks_statistic(df: DataFrame, by: Sequence[str], first: Column, value: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and standardized mean difference of ``value`` between the rows that are ``first`` and the others."""
    v = F.col(value)
    rows = df.where(v.isNotNull())
    run = running(_by_score(rows, by, first, v.cast("double"), None), by, [F.col("__s")], {"__cp": "__p", "__cq": "__q"})
    totals = rows.groupBy(*by).agg(
        F.count_if(first).alias("__np"), F.count_if(~first).alias("__nq"), F.avg(F.when(first, v)).alias("__mp"), F.avg(F.when(~first, v)).alias("__mq"), F.var_samp(F.when(first, v)).alias("__vp"), F.var_samp(F.when(~first, v)).alias("__vq")
    )
    joined = run.crossJoin(F.broadcast(totals)) if not by else run.join(totals, list(by))
    gap = F.abs(_div((F.col("__cp") + F.col("__p")) * 1.0, F.col("__np")) - _div((F.col("__cq") + F.col("__q")) * 1.0, F.col("__nq")))
    agg = joined.groupBy(*by).agg(F.max(gap).alias("__ks"), *[F.first(c).alias(c) for c in ("__mp", "__mq", "__vp", "__vq")])
    return _named(agg, by, ks=F.col("__ks"), smd=_div(F.col("__mp") - F.col("__mq"), F.sqrt((F.col("__vp") + F.col("__vq")) / 2)))
