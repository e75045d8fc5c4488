"""Aggregations and metrics (a01-a32)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_id
from ..operators import joins
from ..operators import metrics as M
from .fixtures import ENSEMBLE, METRICS, ensemble, scored_metrics
from .fragments import BASE
from .registry import query, table

U, CITED, IS_X, IS_A = "label = 2", "label <> 2", "label = 1", "label = 0"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 6))


@query("SELECT 'train' AS split, label, count(*) AS rows FROM train GROUP BY label UNION ALL SELECT 'validation', label, count(*) FROM validation GROUP BY label UNION ALL SELECT 'test', label, count(*) FROM test GROUP BY label")
def a01_value_counts(spark: SparkSession, folder: str) -> DataFrame:
    from ..sources.tables import load_splits

    return load_splits(spark, folder, ["train", "validation", "test"], ["label"]).groupBy("split", "label").agg(F.count("*").alias("rows"))


@query(f"SELECT label, count(DISTINCT claim_id) AS claims, count(DISTINCT {BASE.format('cited_document_id')}) AS documents FROM train GROUP BY label")
def a02_count_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "train").groupBy("label").agg(F.countDistinct("claim_id").alias("claims"), F.countDistinct(F.coalesce(base_id("cited_document_id"), F.lit(""))).alias("documents"))


@query(f"WITH {ENSEMBLE} SELECT training_condition, evaluation_condition, query_id, source_row_id, candidate_type, score, round(sd, 6) AS sd, seeds FROM ens")
def a03_seed_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    return ensemble(spark, folder).withColumn("sd", F.round("sd", 6))


@query(f"WITH {METRICS} SELECT _row_id, label, round(avg(p_a), 6) AS p_a, round(avg(p_x), 6) AS p_x, round(avg(p_u), 6) AS p_u FROM m GROUP BY _row_id, label")
def a04_vector_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    return scored_metrics(spark, folder).groupBy("_row_id", "label").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("p_a", "p_x", "p_u")])


_SEED_ACC = f"WITH {METRICS}, s AS (SELECT seed, avg((label = predicted)::INT) AS v FROM m GROUP BY seed)"


@query(_SEED_ACC + " SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std_pop FROM s")
def a05_seed_mean_std_pop(spark: SparkSession, folder: str) -> DataFrame:
    v = M.accuracy_f1(scored_metrics(spark, folder), ["seed"], "label", "predicted").where("metric = 'accuracy'")
    return v.agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std_pop"))


@query(_SEED_ACC + " SELECT round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std_samp, round(min(v), 6) AS least, round(max(v), 6) AS most FROM s")
def a06_seed_mean_std_samp(spark: SparkSession, folder: str) -> DataFrame:
    v = M.accuracy_f1(scored_metrics(spark, folder), ["seed"], "label", "predicted").where("metric = 'accuracy'")
    return v.agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std_samp"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))


@query("SELECT _target_date_source AS source, count(*) AS queries, round(avg(_random_pool_size), 6) AS mean, median(_random_pool_size)::DOUBLE AS median, min(_random_pool_size) AS least, max(_random_pool_size) AS most FROM generate_random_u GROUP BY 1")
def a07_pool_statistics(spark: SparkSession, folder: str) -> DataFrame:
    p = "_random_pool_size"
    return table(spark, folder, "generate_random_u").groupBy(F.col("_target_date_source").alias("source")).agg(F.count("*").alias("queries"), F.round(F.avg(p), 6).alias("mean"), F.percentile(p, 0.5).alias("median"), F.min(p).alias("least"), F.max(p).alias("most"))


@query(f"WITH {ENSEMBLE} SELECT query_id, candidate_type, round(avg(score), 8) AS score FROM ens GROUP BY ALL")
def a08_mean_by_key(spark: SparkSession, folder: str) -> DataFrame:
    return ensemble(spark, folder).groupBy("query_id", "candidate_type").agg(F.round(F.avg("score"), 8).alias("score"))


@query(f"SELECT claim_id, list_sort(list(DISTINCT {BASE.format('cited_document_id')})) AS documents, list_sort(list(label)) AS labels FROM test GROUP BY claim_id")
def a09_group_lists(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "test").groupBy("claim_id").agg(F.array_sort(F.collect_set(F.coalesce(base_id("cited_document_id"), F.lit("")))).alias("documents"), F.array_sort(F.collect_list("label")).alias("labels"))


_F1 = ", ".join(f"coalesce(2.0 * sum((label = {k} AND predicted = {k})::INT) / nullif(sum((label = {k})::INT) + sum((predicted = {k})::INT), 0), 0) AS f1_{k}" for k in range(3))


@query(f"WITH {METRICS} SELECT seed, 'accuracy' AS metric, round(avg((label = predicted)::INT), 6) AS value FROM m GROUP BY seed")
def a10_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(M.accuracy_f1(scored_metrics(spark, folder), ["seed"], "label", "predicted").where("metric = 'accuracy'"))


@query(f"WITH {METRICS}, f AS (SELECT seed, {_F1} FROM m GROUP BY seed), g AS (SELECT *, (f1_0 + f1_1 + f1_2) / 3 AS macro_f1 FROM f) UNPIVOT_".replace("UNPIVOT_", "SELECT seed, metric, round(value, 6) AS value FROM (UNPIVOT g ON f1_0, f1_1, f1_2, macro_f1 INTO NAME metric VALUE value)"))
def a11_f1(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(M.accuracy_f1(scored_metrics(spark, folder), ["seed"], "label", "predicted").where("metric <> 'accuracy'"))


def _auc(rows: str, by: str, score: str, positive: str, weight: str = "1", name: str = "roc_auc") -> str:
    """AUC by comparing all pairs."""
    return f"""SELECT {by}, '{name}' AS metric, round(sum(w * v * CASE WHEN s > t THEN 1.0 WHEN s = t THEN 0.5 ELSE 0 END) / sum(w * v), 6) AS value
        FROM (SELECT {by}, {score} AS s, {weight} AS w FROM {rows} WHERE {positive}) JOIN (SELECT {by}, {score} AS t, {weight} AS v FROM {rows} WHERE NOT ({positive})) USING ({by}) GROUP BY {by}"""


@query(f"WITH {METRICS} {_auc('m', 'seed', 'cited', CITED)}")
def a12_roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(M.roc_auc(scored_metrics(spark, folder), ["seed"], F.expr(CITED), "cited"))


@query(f"WITH {METRICS}, n AS (SELECT * FROM m WHERE query IN (SELECT query FROM m WHERE {U})) {_auc('n', 'seed', 'cited', CITED)}")
def a12_roc_auc_eligible(spark: SparkSession, folder: str) -> DataFrame:
    """Cited against uncited within the queries that own an uncited row; a12_roc_auc takes all rows."""
    return _rounded(M.roc_auc(joins.owners(scored_metrics(spark, folder), "query", F.expr(U)), ["seed"], F.expr(CITED), "cited"))


@query(f"WITH {METRICS}, n AS (SELECT * FROM m WHERE {CITED}) {_auc('n', 'seed', 'xs', IS_X)}")
def a12_roc_auc_x_vs_a(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(M.roc_auc(scored_metrics(spark, folder).where(CITED), ["seed"], F.expr(IS_X), "xs"))


@query(f"WITH {METRICS}, n AS (SELECT *, length(query) % 3 + seed % 2 AS w0 FROM m) {_auc('n', 'seed', 'cited', CITED, 'w0')}")
def a13_roc_auc_weighted(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(M.roc_auc(scored_metrics(spark, folder), ["seed"], F.expr(CITED), "cited", F.expr("length(query) % 3 + seed % 2")))


@query(f"WITH {METRICS}, n AS (SELECT *, CASE WHEN {CITED} THEN 1.0::DOUBLE / sum(({CITED})::INT) OVER (PARTITION BY seed, query) ELSE 1.0 END AS w0 FROM m) {_auc('n', 'seed', 'cited', CITED, 'w0', 'macro_roc_auc')}")
def a14_roc_auc_query_macro(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(M.macro_roc_auc(scored_metrics(spark, folder), ["seed"], "query", F.expr(CITED), "cited"))


@query(f"""WITH {METRICS}, g AS (SELECT seed, cited, sum(({CITED})::INT) AS p, count(*) AS n FROM m GROUP BY ALL),
    c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (PARTITION BY seed ORDER BY cited DESC))
    SELECT seed, 'average_precision' AS metric, round(sum(p * cp / cn) / sum(p), 6) AS value FROM c GROUP BY seed""")
def a15_average_precision(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(M.average_precision(scored_metrics(spark, folder), ["seed"], F.expr(CITED), "cited"))


@query(f"""WITH {METRICS}, c AS (SELECT seed, ({CITED})::INT AS y, row_number() OVER w AS r, sum(({CITED})::INT) OVER (PARTITION BY seed ORDER BY cited DESC, _row_id ROWS UNBOUNDED PRECEDING) AS tp FROM m WINDOW w AS (PARTITION BY seed ORDER BY cited DESC, _row_id))
    SELECT seed, 'average_precision_rowwise' AS metric, round(sum(y * tp / r) / sum(y), 6) AS value FROM c GROUP BY seed""")
def a16_average_precision_rowwise(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(M.average_precision_rowwise(scored_metrics(spark, folder), ["seed"], F.expr(CITED), "cited", "_row_id"))


@query(f"WITH {METRICS} SELECT seed, query, CASE WHEN count(DISTINCT ({CITED})) = 2 THEN round((SELECT sum(CASE WHEN p.cited > q.cited THEN 1.0 WHEN p.cited = q.cited THEN 0.5 ELSE 0 END) / count(*) FROM m p JOIN m q ON p.seed = q.seed AND p.query = q.query AND p.label <> 2 AND q.label = 2 WHERE p.seed = m.seed AND p.query = m.query), 6) END AS value FROM m GROUP BY seed, query")
def a17_null_for_one_class(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(M.roc_auc(scored_metrics(spark, folder), ["seed", "query"], F.expr(CITED), "cited").drop("metric"))


def _pairs(score: str, better: str, worse: str) -> str:
    return f"""SELECT p.seed, p.query, avg(CASE WHEN p.{score} > q.{score} THEN 1.0 WHEN p.{score} = q.{score} THEN 0.5 ELSE 0 END) AS v
        FROM m p JOIN m q ON p.seed = q.seed AND p.query = q.query AND p.{better} AND q.{worse} GROUP BY ALL"""


@query(f"WITH {METRICS}, v AS ({_pairs('cited', CITED, U)}) SELECT seed, 'pairwise' AS metric, round(avg(v), 6) AS value FROM v GROUP BY seed")
def a18_pairwise(spark: SparkSession, folder: str) -> DataFrame:
    v = M.pairwise_by_query(scored_metrics(spark, folder), ["seed"], "query", F.expr(CITED), F.expr(U), "cited")
    return _rounded(M.mean_of_queries(v, ["seed"], "pairwise"))


@query(f"WITH {METRICS}, v AS ({_pairs('xs', IS_X, IS_A)}) SELECT seed, 'pairwise_x_over_a' AS metric, round(avg(v), 6) AS value FROM v GROUP BY seed")
def a19_pairwise_x_over_a(spark: SparkSession, folder: str) -> DataFrame:
    v = M.pairwise_by_query(scored_metrics(spark, folder), ["seed"], "query", F.expr(IS_X), F.expr(IS_A), "xs")
    return _rounded(M.mean_of_queries(v, ["seed"], "pairwise_x_over_a"))


@query(f"WITH {METRICS}, v AS ({_pairs('cited', CITED, U)}), one AS (SELECT seed, query FROM m WHERE {U} GROUP BY ALL HAVING count(*) = 1) SELECT seed, query, round(v, 6) AS value FROM v JOIN one USING (seed, query)")
def a20_pairwise_single_u(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(M.single_pairwise(scored_metrics(spark, folder), ["seed"], "query", F.expr(CITED), F.expr(U), "cited"))


@query(f"WITH {METRICS}, r AS (SELECT seed, query, label, row_number() OVER (PARTITION BY seed, query ORDER BY cited DESC, _row_id) AS r FROM m), v AS (SELECT seed, query, 1.0 / min(r) AS v FROM r WHERE {CITED} GROUP BY ALL) SELECT seed, 'mrr' AS metric, round(avg(v), 6) AS value FROM v GROUP BY seed")
def a21_mrr(spark: SparkSession, folder: str) -> DataFrame:
    v = M.reciprocal_rank_by_query(scored_metrics(spark, folder), ["seed"], "query", F.expr(CITED), "cited", "_row_id")
    return _rounded(M.mean_of_queries(v, ["seed"], "mrr"))


_GRADE = "CASE label WHEN 1 THEN 2 WHEN 0 THEN 1 ELSE 0 END"


@query(f"""WITH {METRICS}, g AS (SELECT seed, query, _row_id, graded, pow(2, {_GRADE}) - 1 AS g FROM m),
    r AS (SELECT seed, query, g / log2(row_number() OVER (PARTITION BY seed, query ORDER BY graded DESC, _row_id) + 1) AS d, g / log2(row_number() OVER (PARTITION BY seed, query ORDER BY g DESC, _row_id) + 1) AS i FROM g),
    v AS (SELECT seed, query, sum(d) / sum(i) AS v FROM r GROUP BY ALL HAVING sum(i) > 0) SELECT seed, 'ndcg' AS metric, round(avg(v), 6) AS value FROM v GROUP BY seed""")
def a22_ndcg_exponential(spark: SparkSession, folder: str) -> DataFrame:
    v = M.ndcg_by_query(scored_metrics(spark, folder), ["seed"], "query", F.expr(_GRADE), "graded", "_row_id")
    return _rounded(M.mean_of_queries(v, ["seed"], "ndcg"))


@query(f"""WITH {METRICS}, g AS (SELECT seed, query, graded, {_GRADE} AS g, 1.0 / log2(row_number() OVER (PARTITION BY seed, query ORDER BY graded DESC) + 1) AS d, 1.0 / log2(row_number() OVER (PARTITION BY seed, query ORDER BY {_GRADE} DESC) + 1) AS i FROM m),
    t AS (SELECT seed, query, graded, avg(g) * sum(d) AS x FROM g GROUP BY ALL), x AS (SELECT seed, query, sum(x) AS x FROM t GROUP BY ALL), y AS (SELECT seed, query, sum(g * i) AS y FROM g GROUP BY ALL)
    SELECT seed, 'ndcg_linear' AS metric, round(avg(x / y), 6) AS value FROM x JOIN y USING (seed, query) WHERE y > 0 GROUP BY seed""")
def a23_ndcg_linear(spark: SparkSession, folder: str) -> DataFrame:
    v = M.ndcg_linear_by_query(scored_metrics(spark, folder), ["seed"], "query", F.expr(_GRADE), "graded")
    return _rounded(M.mean_of_queries(v, ["seed"], "ndcg_linear"))


@query("SELECT training_condition, 'mean' AS metric, round(avg(cited_probability), 6) AS value FROM predictions_long WHERE NOT isnan(cited_probability) GROUP BY 1")
def a24_mean_of_finite(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "predictions_long").withColumnRenamed("cited_probability", "value")
    return _rounded(M.mean_of_queries(v, ["training_condition"], "mean"))


@query(f"WITH {METRICS}, v AS ({_pairs('cited', CITED, U)}) SELECT seed, 'weighted' AS metric, round(sum(v * (length(query) % 4 + 1)) / sum(length(query) % 4 + 1), 6) AS value FROM v GROUP BY seed")
def a25_weighted_mean(spark: SparkSession, folder: str) -> DataFrame:
    v = M.pairwise_by_query(scored_metrics(spark, folder), ["seed"], "query", F.expr(CITED), F.expr(U), "cited")
    return _rounded(M.mean_of_queries(v.withColumn("w", F.expr("length(query) % 4 + 1")), ["seed"], "weighted", "w"))


@query(f"""WITH {METRICS}, v AS ({_pairs('cited', CITED, U)}), n AS (SELECT seed, query, sum(({CITED})::INT) * sum(({U})::INT) AS n FROM m GROUP BY ALL)
    SELECT seed, round(avg(v), 6) AS query_macro, round(sum(v * n) / sum(n), 6) AS pair_weighted FROM v JOIN n USING (seed, query) GROUP BY seed""")
def a26_pairwise_weighting(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored_metrics(spark, folder)
    v = M.pairwise_by_query(rows, ["seed"], "query", F.expr(CITED), F.expr(U), "cited")
    n = rows.groupBy("seed", "query").agg((F.count_if(F.expr(CITED)) * F.count_if(F.expr(U))).alias("n"))
    return v.join(n, ["seed", "query"]).groupBy("seed").agg(F.round(F.avg("value"), 6).alias("query_macro"), F.round(F.sum(F.col("value") * F.col("n")) / F.sum("n"), 6).alias("pair_weighted"))


@query(f"WITH {METRICS}, g AS (SELECT seed, avg(cited) FILTER (label = 0) AS mean_a, avg(cited) FILTER (label = 1) AS mean_x, avg(cited) FILTER (label = 2) AS mean_u FROM m GROUP BY seed) SELECT seed, metric, round(value, 6) AS value FROM (UNPIVOT g ON mean_a, mean_x, mean_u INTO NAME metric VALUE value)")
def a27_mean_by_class(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(M.mean_score_by_class(scored_metrics(spark, folder), ["seed"], "label", "cited"))


@query(f"WITH {METRICS}, g AS (SELECT seed, avg(abs(p_a - p_x)) AS mae, max(abs(p_a - p_x)) AS max_abs, avg(p_a - p_x) AS mean_difference, corr(p_a, p_x) AS correlation FROM m GROUP BY seed) SELECT seed, metric, round(value, 6) AS value FROM (UNPIVOT g ON mae, max_abs, mean_difference, correlation INTO NAME metric VALUE value)")
def a28_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(M.agreement(scored_metrics(spark, folder), ["seed"], "p_a", "p_x"))


@query(f"WITH {METRICS} SELECT seed, count(cited) AS n, round(avg(cited), 6) AS mean, round(stddev_samp(cited), 6) AS std, min(cited) AS least, round(quantile_cont(cited, 0.25), 6) AS q25, round(quantile_cont(cited, 0.5), 6) AS q50, round(quantile_cont(cited, 0.75), 6) AS q75, max(cited) AS most FROM m GROUP BY seed")
def a29_describe(spark: SparkSession, folder: str) -> DataFrame:
    q = {f"q{k}": F.round(F.percentile("cited", k / 100), 6) for k in (25, 50, 75)}
    aggs = [F.count("cited").alias("n"), F.round(F.avg("cited"), 6).alias("mean"), F.round(F.stddev_samp("cited"), 6).alias("std"), F.min("cited").alias("least"), F.max("cited").alias("most"), *[c.alias(n) for n, c in q.items()]]
    return scored_metrics(spark, folder).groupBy("seed").agg(*aggs)


@query(f"WITH {METRICS}, r AS (SELECT _row_id, count(DISTINCT predicted) AS kinds, max(cited) - min(cited) AS spread FROM m GROUP BY 1) SELECT count(*) AS rows, sum((kinds = 1)::INT)::BIGINT AS unanimous, round(avg(spread), 6) AS mean_range FROM r")
def a30_seed_disagreement(spark: SparkSession, folder: str) -> DataFrame:
    r = scored_metrics(spark, folder).groupBy("_row_id").agg(F.countDistinct("predicted").alias("kinds"), (F.max("cited") - F.min("cited")).alias("spread"))
    return r.agg(F.count("*").alias("rows"), F.count_if(F.col("kinds") == 1).alias("unanimous"), F.round(F.avg("spread"), 6).alias("mean_range"))


@query(f"""WITH {METRICS}, b AS (SELECT CASE WHEN length(coalesce(text_b, '')) <= 300 THEN 'short' WHEN length(coalesce(text_b, '')) <= 600 THEN 'middle' ELSE 'long' END AS bucket, m.label, predicted FROM m JOIN test USING (_row_id)),
    c AS (SELECT bucket, label, count(*) AS n, sum((label = predicted)::INT) AS ok FROM b GROUP BY ALL)
    SELECT bucket, sum(n)::BIGINT AS rows, round(sum(ok) / sum(n), 6) AS accuracy, round(avg(ok / n), 6) AS balanced_accuracy FROM c GROUP BY bucket""")
def a31_bucketed_performance(spark: SparkSession, folder: str) -> DataFrame:
    size = F.length(F.coalesce("text_b", F.lit("")))
    bucket = table(spark, folder, "test").select("_row_id", F.when(size <= 300, "short").when(size <= 600, "middle").otherwise("long").alias("bucket"))
    c = scored_metrics(spark, folder).join(bucket, "_row_id").groupBy("bucket", "label").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("predicted")).alias("ok"))
    return c.groupBy("bucket").agg(F.sum("n").alias("rows"), F.round(F.sum("ok") / F.sum("n"), 6).alias("accuracy"), F.round(F.avg(F.col("ok") / F.col("n")), 6).alias("balanced_accuracy"))


@query("""WITH v AS (SELECT 'claim' AS what, true AS f, length(text) AS x FROM train UNION ALL SELECT 'claim', false, length(text) FROM test UNION ALL SELECT 'passage', true, length(text_b) FROM train UNION ALL SELECT 'passage', false, length(text_b) FROM test),
    w AS (SELECT * FROM v WHERE x IS NOT NULL),
    t AS (SELECT what, count(*) FILTER (f) AS np, count(*) FILTER (NOT f) AS nq, avg(x) FILTER (f) AS mp, avg(x) FILTER (NOT f) AS mq, var_samp(x) FILTER (f) AS vp, var_samp(x) FILTER (NOT f) AS vq FROM w GROUP BY what),
    c AS (SELECT DISTINCT what, x, sum(f::INT) OVER (PARTITION BY what ORDER BY x) AS cp, sum((NOT f)::INT) OVER (PARTITION BY what ORDER BY x) AS cq FROM w),
    k AS (SELECT what, max(abs(cp / np - cq / nq)) AS ks FROM c JOIN t USING (what) GROUP BY what)
    SELECT what, 'ks' AS metric, round(ks, 6) AS value FROM k UNION ALL SELECT what, 'smd', round((mp - mq) / sqrt((vp + vq) / 2), 6) FROM t""")
def a32_ks_smd(spark: SparkSession, folder: str) -> DataFrame:
    from ..sources.tables import load_splits

    rows = load_splits(spark, folder, ["train", "test"], ["text", "text_b"])
    long = rows.select("split", F.explode(F.array(F.struct(F.lit("claim").alias("what"), F.length("text").alias("x")), F.struct(F.lit("passage").alias("what"), F.length("text_b").alias("x")))).alias("v")).select("split", "v.what", "v.x")
    return _rounded(M.ks_statistic(long, ["what"], F.col("split") == "train", "x"))
