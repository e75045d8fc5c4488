"""Resampling and inference (b01-b12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bootstrap
from ..operators import inference as I
from ..operators import metrics as M
from ..operators import resample as R
from ..plans.cut import cut
from .composites import _BINS, _FLAGS, _dated, g23_subsets
from .fixtures import METRICS, scored_metrics
from .registry import query, table

REPLICATES, SEED = 2000, 42


def _draws(source: str, key: str = "query", extra: str = "", part: str = "''") -> str:
    """SQL of the weights relation over the distinct keys of a source."""
    by = f"{extra}, " if extra else ""
    window = f"(PARTITION BY {extra} ORDER BY {key})" if extra else f"(ORDER BY {key})"
    total = f"(PARTITION BY {extra})" if extra else "()"
    return f"""qn AS (SELECT {by}{key}, row_number() OVER {window} - 1 AS i, count(*) OVER {total} AS n FROM (SELECT DISTINCT {by}{key} FROM {source})),
    dr AS (SELECT {by}replicate, (('0x' || substr(md5('{SEED}|' || {part} || replicate || '|' || i), 1, 12))::UBIGINT % n)::BIGINT AS i FROM qn, (SELECT unnest(range({REPLICATES}))::INT AS replicate)),
    ww AS (SELECT {by}replicate, {key}, count(*) AS w FROM dr JOIN qn USING ({by}i) GROUP BY ALL)"""


_AUC = """(SELECT {by}, sum(p * (below + q / 2.0::DOUBLE)) / nullif(sum(p) * sum(q), 0) AS value FROM
    (SELECT *, coalesce(sum(q) OVER (PARTITION BY {by} ORDER BY cited ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM
    (SELECT {by}, cited, sum(CASE WHEN label <> 2 THEN w ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN label = 2 THEN w ELSE 0 END)::DOUBLE AS q FROM x GROUP BY ALL)) GROUP BY {by})"""


def _replicate_auc(spark: SparkSession, folder: str) -> DataFrame:
    """ROC-AUC of each seed (the systems, here) in each replicate; systems share the draws."""
    s = cut(scored_metrics(spark, folder).select("seed", "query", "label", "cited"))
    w = bootstrap.weight_vectors(R.numbered_queries(s, "query"), "query", REPLICATES, SEED)
    return bootstrap.replicate_auc(s, ["seed"], "query", F.col("label") != 2, "cited", w, REPLICATES)


_REPL = f"WITH {METRICS}, {_draws('m')}, x AS (SELECT seed, replicate, label, cited, w FROM m JOIN ww USING (query)), v AS {_AUC.format(by='seed, replicate')}"


@query(f"{_REPL} SELECT seed, round(quantile_cont(value, 0.025), 6) AS ci_lower, round(quantile_cont(value, 0.975), 6) AS ci_upper, count(value) AS replicates FROM v GROUP BY seed")
def b01_bootstrap_auc(spark: SparkSession, folder: str) -> DataFrame:
    ci = I.percentile_interval(_replicate_auc(spark, folder), ["seed"], "value")
    return ci.withColumns({c: F.round(c, 6) for c in ("ci_lower", "ci_upper")})


_BIN_DRAWS = _draws("b", extra="bin", part="bin || '|' ")
_BIN_REPL = f"WITH {METRICS}, {_BINS}, b AS (SELECT m.*, bins.bin FROM m JOIN bins ON m.query = bins.claim_id ), {_BIN_DRAWS}, x AS (SELECT b.seed, b.bin, replicate, label, cited, w FROM b JOIN ww USING (bin, query)), v AS {_AUC.format(by='seed, bin, replicate')}"


def _bin_auc(spark: SparkSession, folder: str) -> DataFrame:
    """Of each seed and bin; seeds share the draws."""
    from ..operators import temporal

    bins = temporal.with_bins(_dated(spark, folder), "day").where("bin is not null").select(F.col("claim_id").alias("query"), "bin")
    b = cut(scored_metrics(spark, folder).join(bins, "query").select("seed", "bin", "query", "label", "cited"))
    w = bootstrap.weight_vectors(R.numbered_queries(b, "query", "bin"), "query", REPLICATES, SEED, "bin")
    return bootstrap.replicate_auc(b, ["seed", "bin"], "query", F.col("label") != 2, "cited", w, REPLICATES, "bin")


@query(f"{_BIN_REPL} SELECT l.seed, l.replicate, round(l.value - e.value, 6) AS delta FROM v l JOIN v e ON l.seed = e.seed AND l.replicate = e.replicate AND l.bin = 'late' AND e.bin = 'early'")
def b02_bin_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """Late less early, each bin drawing its own queries."""
    v = cut(_bin_auc(spark, folder))
    late, early = v.where("bin = 'late'").select("seed", "replicate", F.col("value").alias("l")), v.where("bin = 'early'").select("seed", "replicate", F.col("value").alias("e"))
    return late.join(early, ["seed", "replicate"]).select("seed", "replicate", F.round(F.col("l") - F.col("e"), 6).alias("delta"))


@query(f"{_BIN_REPL} SELECT seed, bin, round(quantile_cont(value, 0.025), 6) AS ci_lower, round(quantile_cont(value, 0.975), 6) AS ci_upper, count(value) AS replicates FROM v GROUP BY seed, bin")
def b03_percentile_interval(spark: SparkSession, folder: str) -> DataFrame:
    return I.percentile_interval(_bin_auc(spark, folder), ["seed", "bin"], "value").withColumns({c: F.round(c, 6) for c in ("ci_lower", "ci_upper")})


_PAIRS = "pr AS (SELECT * FROM (VALUES (13, 42), (13, 77), (42, 77)) t(first, second)), de AS (SELECT a.replicate, first, second, b.value - a.value AS delta FROM pr JOIN v a ON a.seed = first JOIN v b ON b.seed = second AND a.replicate = b.replicate)"
_PV = "pv AS (SELECT first, second, least(1.0, 2 * least((count(*) FILTER (delta <= 0) + 1) / (count(delta) + 1), (count(*) FILTER (delta >= 0) + 1) / (count(delta) + 1))) AS p_value FROM de GROUP BY ALL)"
_HOLM = "hs AS (SELECT *, row_number() OVER (PARTITION BY {f} ORDER BY p_value, second, first) AS k, count(*) OVER (PARTITION BY {f}) AS n FROM pv), ho AS (SELECT *, least(1.0, max((n - k + 1) * p_value) OVER (PARTITION BY {f} ORDER BY p_value, second, first ROWS UNBOUNDED PRECEDING)) AS p_adjusted FROM hs)"


def _deltas(spark: SparkSession, folder: str) -> DataFrame:
    pairs = spark.createDataFrame([(13, 42), (13, 77), (42, 77)], "first int, second int")
    return I.contrasts(cut(_replicate_auc(spark, folder)), ["replicate"], "seed", pairs)


def _p_values(spark: SparkSession, folder: str) -> DataFrame:
    return I.tail_p(_deltas(spark, folder), ["first", "second"], "delta").withColumn("pair", F.expr("second * 1000 + first"))


@query(f"{_REPL}, {_PAIRS}, {_PV} SELECT first, second, round(p_value, 9) AS p_value FROM pv")
def b04_tail_p(spark: SparkSession, folder: str) -> DataFrame:
    return _p_values(spark, folder).select("first", "second", F.round("p_value", 9).alias("p_value"))


@query(f"{_REPL}, {_PAIRS}, {_PV}, {_HOLM.format(f='1')} SELECT first, second, round(p_adjusted, 9) AS p_adjusted, p_adjusted < 0.05 AS significant FROM ho")
def b05_holm(spark: SparkSession, folder: str) -> DataFrame:
    """b10's flag is ``significant``."""
    return I.holm(_p_values(spark, folder), [], "p_value", "pair").select("first", "second", F.round("p_adjusted", 9).alias("p_adjusted"), "significant")


@query(f"{_REPL}, {_PAIRS}, {_PV}, {_HOLM.format(f='first')} SELECT first, second, round(p_adjusted, 9) AS p_adjusted FROM ho")
def b06_family_holm(spark: SparkSession, folder: str) -> DataFrame:
    return I.holm(_p_values(spark, folder), ["first"], "p_value", "pair").select("first", "second", F.round("p_adjusted", 9).alias("p_adjusted"))


@query(f"{_REPL}, {_PAIRS} SELECT replicate, first, second, round(delta, 6) AS delta FROM de")
def b07_contrasts(spark: SparkSession, folder: str) -> DataFrame:
    return _deltas(spark, folder).withColumn("delta", F.round("delta", 6))


@query(f"{_REPL} SELECT seed, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM v GROUP BY seed")
def b08_bootstrap_mean_std(spark: SparkSession, folder: str) -> DataFrame:
    return I.mean_std(_replicate_auc(spark, folder), ["seed"], "value").withColumns({c: F.round(c, 6) for c in ("mean", "std")})


_APP_DRAWS = _draws("small", extra="app", part="app || '|' ")


@query(f"""WITH {METRICS}, small AS (SELECT *, split_part(query, '_', 1) AS app FROM m), {_APP_DRAWS}, x AS (SELECT seed, app, replicate, label FROM small JOIN ww USING (app, query)),
    k AS (SELECT seed, app, replicate, count(DISTINCT (label = 2)) AS k FROM x GROUP BY ALL) SELECT seed, app, count(*) AS replicates, count(*) FILTER (k = 2) AS usable FROM k GROUP BY seed, app""")
def b09_one_class_replicates(spark: SparkSession, folder: str) -> DataFrame:
    """Replicates within each application's few queries, and how many of them have both classes; the others' AUC is null."""
    s = cut(scored_metrics(spark, folder).withColumn("app", F.substring_index("query", "_", 1)).select("seed", "app", "query", "label", "cited"))
    w = bootstrap.weight_vectors(R.numbered_queries(s, "query", "app"), "query", REPLICATES, SEED, "app")
    v = bootstrap.replicate_auc(s, ["seed", "app"], "query", F.col("label") != 2, "cited", w, REPLICATES, "app")
    return v.groupBy("seed", "app").agg(F.count("*").alias("replicates"), F.count("value").alias("usable"))


@query(f"{_REPL}, {_PAIRS}, {_PV} SELECT first, second, p_value < 0.05 AS significant FROM pv")
def b10_significance(spark: SparkSession, folder: str) -> DataFrame:
    return _p_values(spark, folder).select("first", "second", (F.col("p_value") < 0.05).alias("significant"))


@query(f"""WITH {METRICS}, e AS (SELECT _row_id, query, label, round(avg(cited), 9) AS cited FROM m GROUP BY ALL),
    s AS (SELECT seed::VARCHAR AS system, query, label, cited FROM m UNION ALL SELECT 'ensemble', query, label, cited FROM e), x AS (SELECT system, label, cited, 1 AS w FROM s) SELECT system, round(value, 6) AS value FROM {_AUC.format(by='system')}""")
def b11_seeds_and_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    s = scored_metrics(spark, folder)
    e = s.groupBy("_row_id", "query", "label").agg(F.round(F.avg("cited"), 9).alias("cited")).select(F.lit("ensemble").alias("system"), "query", "label", "cited")
    both = s.select(F.col("seed").cast("string").alias("system"), "query", "label", "cited").unionByName(e)
    return M.roc_auc(both, ["system"], F.col("label") != 2, "cited").select("system", F.round("value", 6).alias("value"))


_FAMILY = f"""WITH {METRICS}, {_FLAGS}, {_draws('m')}, sub AS (SELECT claim_id AS query, unnest(list_filter(['all', CASE WHEN NOT same_passage THEN 'passage_different' END, CASE WHEN NOT same_document THEN 'document_different' END], lambda x: x IS NOT NULL)) AS subset FROM fl),
    t AS (SELECT subset, m.* FROM m JOIN sub USING (query)), x AS (SELECT 'cited' AS model, subset, seed, replicate, label, cited, w FROM t JOIN ww USING (query) UNION ALL SELECT 'graded', subset, seed, replicate, label, graded, w FROM t JOIN ww USING (query)), v AS {_AUC.format(by='model, subset, seed, replicate')},
    de AS (SELECT a.model, a.subset, b.seed AS second, b.value - a.value AS delta FROM v a JOIN v b USING (model, subset, replicate) WHERE a.seed = 13 AND b.seed <> 13),
    pv AS (SELECT model, subset, second, least(1.0, 2 * least((count(*) FILTER (delta <= 0) + 1) / (count(delta) + 1), (count(*) FILTER (delta >= 0) + 1) / (count(delta) + 1))) AS p_value FROM de GROUP BY ALL),
    hs AS (SELECT *, row_number() OVER (ORDER BY p_value) AS k, count(*) OVER () AS n FROM pv), ho AS (SELECT *, least(1.0, max((n - k + 1) * p_value) OVER (ORDER BY p_value, k ROWS UNBOUNDED PRECEDING)) AS p_adjusted FROM hs)"""


@query(f"{_FAMILY} SELECT model, subset, second, round(p_value, 9) AS p_value, round(p_adjusted, 9) AS p_adjusted, p_adjusted < 0.05 AS significant FROM ho")
def b12_global_family(spark: SparkSession, folder: str) -> DataFrame:
    """One family of twelve tests: two models' scores, three subsets, two contrasts (seeds 42 and 77 against 13), p from the replicates."""
    s = scored_metrics(spark, folder)
    w = bootstrap.weight_vectors(R.numbered_queries(s, "query"), "query", REPLICATES, SEED)
    t = s.join(g23_subsets(spark, folder).withColumnRenamed("claim_id", "query"), "query")
    models = [t.select(F.lit(m).alias("model"), "subset", "seed", "query", "label", F.col(m).alias("score")) for m in ("cited", "graded")]
    v = bootstrap.replicate_auc(cut(models[0].unionByName(models[1])), ["model", "subset", "seed"], "query", F.col("label") != 2, "score", w, REPLICATES)
    pairs = spark.createDataFrame([(13, 42), (13, 77)], "first int, second int")
    p = I.tail_p(I.contrasts(cut(v), ["model", "subset", "replicate"], "seed", pairs), ["model", "subset", "second"], "delta")
    ordered = p.withColumn("o", F.concat_ws("|", "model", "subset", "second"))
    return I.holm(ordered, [], "p_value", "o").select("model", "subset", "second", F.round("p_value", 9).alias("p_value"), F.round("p_adjusted", 9).alias("p_adjusted"), "significant")
