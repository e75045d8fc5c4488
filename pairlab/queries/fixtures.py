"""Tables derived from the test tables that several queries start from, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import probs as P
from .fragments import UNIFORM
from .registry import table

SEEDS = (13, 42, 77)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Test rows with three class probabilities for each seed, from hashes on a grid (so ties are exact)."""
    rows = table(spark, folder, "test").select("_row_id", F.col("claim_id").alias("query"), "label", F.explode(F.array(*[F.lit(s) for s in SEEDS])).alias("seed"))
    u = [H.uniform("_row_id", "seed", F.lit(k)) for k in range(3)]
    return rows.select("*", *[c.alias(n) for n, c in zip(("p_a", "p_x", "p_u"), u)])


SCORED = f"""scored AS (SELECT _row_id, claim_id AS query, label, seed,
    {UNIFORM.format("_row_id || '|' || seed || '|0'")} AS p_a, {UNIFORM.format("_row_id || '|' || seed || '|1'")} AS p_x, {UNIFORM.format("_row_id || '|' || seed || '|2'")} AS p_u
    FROM test, (SELECT unnest([13, 42, 77])::INT AS seed))"""


def scored_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """``scored`` with the scores that metrics use."""
    s = scored(spark, folder)
    return s.select("*", F.round(P.cited_score("p_a", "p_x"), 6).alias("cited"), F.round(P.x_score("p_a", "p_x"), 6).alias("xs"), F.round(P.graded_score("p_a", "p_x"), 6).alias("graded"), P.argmax_class(["p_a", "p_x", "p_u"]).alias("predicted"))


METRICS = SCORED + """, m AS (SELECT *, round(p_a + p_x, 6) AS cited, round(p_x / (p_a + p_x + 1e-12), 6) AS xs, round(p_a + 2 * p_x, 6) AS graded,
    CASE WHEN p_a >= greatest(p_x, p_u) THEN 0 WHEN p_x >= p_u THEN 1 ELSE 2 END AS predicted FROM scored)"""


def ensemble(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions with a probability, one for each row, query and conditions: the mean over seeds."""
    p = table(spark, folder, "predictions_long").where("cited_probability >= 0 and cited_probability <= 1")
    one = p.groupBy("training_condition", "evaluation_condition", "query_id", "source_row_id", "candidate_type", "seed").agg(F.max("cited_probability").alias("p"))
    return one.groupBy("training_condition", "evaluation_condition", "query_id", "source_row_id", "candidate_type").agg(F.round(F.avg("p"), 6).alias("score"), F.stddev_samp("p").alias("sd"), F.count("*").alias("seeds"))


ENSEMBLE = """one AS (SELECT training_condition, evaluation_condition, query_id, source_row_id, candidate_type, seed, max(cited_probability) AS p FROM predictions_long
    WHERE cited_probability >= 0 AND cited_probability <= 1 AND NOT isnan(cited_probability) GROUP BY ALL),
    ens AS (SELECT training_condition, evaluation_condition, query_id, source_row_id, candidate_type, round(avg(p), 6) AS score, stddev_samp(p) AS sd, count(*) AS seeds FROM one GROUP BY ALL)"""
