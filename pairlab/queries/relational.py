"""Joins, windows, sorts and set operations (j01-j16, w01-w10, k01-k07, o01-o06)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions.collections import parse_codes, parse_references
from ..functions.dates import parse_date
from ..functions.text import base_id, normalize_text
from ..operators import audits, eligible, joins, ranking, resample, vectors
from ..operators.inference import holm
from ..plans.cut import cut
from ..plans.sequence import global_sequence, running
from ..sources.tables import load_splits
from .fixtures import ENSEMBLE, METRICS, ensemble, scored_metrics
from .fragments import BASE, CODES, DATE, NORM, REFERENCES
from .registry import query, table

_PAIRS3 = "(SELECT 'train' AS split, * FROM train UNION ALL SELECT 'validation', * FROM validation UNION ALL SELECT 'test', * FROM test)"


@query(f"WITH {METRICS} SELECT a._row_id, a.label, a.cited AS first, b.cited AS second FROM m a JOIN m b ON a._row_id = b._row_id AND a.seed = 13 AND b.seed = 42 ORDER BY a._row_id")
def j01_one_to_one(spark: SparkSession, folder: str) -> DataFrame:
    s = scored_metrics(spark, folder)
    a = s.where("seed = 13").select("_row_id", "label", F.col("cited").alias("first"))
    b = s.where("seed = 42").select("_row_id", "label", F.col("cited").alias("second"))
    return joins.one_to_one(a, b, "_row_id", agree="label").orderBy("_row_id")


@query(f"WITH {ENSEMBLE} SELECT t._row_id, e.score FROM test t LEFT JOIN (SELECT source_row_id, max(score) AS score FROM ens WHERE training_condition = 'mixed_u' GROUP BY 1) e ON t._row_id = e.source_row_id ORDER BY 1")
def j02_template_order(spark: SparkSession, folder: str) -> DataFrame:
    e = ensemble(spark, folder).where("training_condition = 'mixed_u'").groupBy(F.col("source_row_id").alias("_row_id")).agg(F.max("score").alias("score"))
    return joins.in_template_order(table(spark, folder, "test").select("_row_id"), "_row_id", e, ["_row_id"])


@query("SELECT p.prediction_row_id, p.seed, t.label, t.claim_id FROM predictions_long p LEFT JOIN test t ON p.source_row_id = t._row_id")
def j03_many_to_one(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "predictions_long").select("prediction_row_id", "seed", F.col("source_row_id").alias("_row_id"))
    return p.join(table(spark, folder, "test").select("_row_id", "label", "claim_id"), "_row_id", "left").select("prediction_row_id", "seed", "label", "claim_id")


@query("WITH v AS (SELECT _u_candidate_base AS base, count(*) AS n FROM train WHERE _u_candidate_base IS NOT NULL GROUP BY 1) SELECT DISTINCT t._u_candidate_base AS base, v.n FROM test t LEFT JOIN v ON t._u_candidate_base = v.base WHERE t._u_candidate_base IS NOT NULL")
def j04_reindex(spark: SparkSession, folder: str) -> DataFrame:
    ids = table(spark, folder, "test").select(F.col("_u_candidate_base").alias("base")).where("base is not null").distinct()
    n = table(spark, folder, "train").groupBy(F.col("_u_candidate_base").alias("base")).agg(F.count("*").alias("n"))
    return ids.join(n, "base", "left")


@query(f"WITH l AS (SELECT {BASE.format('cited_document_id')} AS k, max(_row_id) AS v FROM train GROUP BY 1) SELECT t._row_id, coalesce(x.v, y.v) AS found FROM test t LEFT JOIN l x ON x.k = t._u_candidate_base LEFT JOIN l y ON y.k = {BASE.format('t.cited_document_id')}")
def j05_fallback_lookup(spark: SparkSession, folder: str) -> DataFrame:
    lookup = table(spark, folder, "train").groupBy(F.coalesce(base_id("cited_document_id"), F.lit("")).alias("k")).agg(F.max("_row_id").alias("v"))
    rows = table(spark, folder, "test").select("_row_id", "_u_candidate_base", F.coalesce(base_id("cited_document_id"), F.lit("")).alias("document"))
    return joins.with_fallback(rows, ["_u_candidate_base", "document"], lookup, "k", "v", "found").select("_row_id", "found")


@query("SELECT DISTINCT p.source_row_id, p.candidate_type, CASE p.candidate_type WHEN 'random_u' THEN r.text_b ELSE t.text_b END AS passage FROM predictions_long p LEFT JOIN test t ON p.source_row_id = t._row_id LEFT JOIN (SELECT _row_id, min(text_b) AS text_b FROM generate_random_u GROUP BY 1) r ON p.source_row_id = r._row_id")
def j06_source_by_row(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "predictions_long").select("source_row_id", "candidate_type").distinct()
    test = table(spark, folder, "test").select("_row_id", F.col("text_b").alias("passage"))
    random = table(spark, folder, "generate_random_u").groupBy("_row_id").agg(F.min("text_b").alias("passage"))
    return joins.by_source(p, "candidate_type", "source_row_id", {"cited": test, "hard_u": test, "random_u": random}, "_row_id", "passage")


@query("SELECT _row_id, claim_id, label FROM test WHERE claim_id IN (SELECT claim_id FROM test WHERE label = 2)")
def j07_eligible_semi(spark: SparkSession, folder: str) -> DataFrame:
    return joins.owners(table(spark, folder, "test").select("_row_id", "claim_id", "label"), "claim_id", F.col("label") == 2)


@query("SELECT _row_id, label FROM test WHERE claim_id NOT IN (SELECT claim_id FROM test WHERE label = 2)")
def j08_anti(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "test").select("_row_id", "claim_id", "label")
    return rows.join(rows.where("label = 2").select("claim_id").distinct(), "claim_id", "left_anti").select("_row_id", "label")


_META = f"""md AS (SELECT coalesce(nullif({BASE.format('base_id')}, ''), {BASE.format('input_id')}) AS base, {DATE.format('publication_date')} AS pub, {CODES.format('cpc_subclasses')} AS codes, row_pos FROM doc_metadata),
    dm AS (SELECT base, arg_max({{'pub': pub, 'codes': codes}}, row_pos) AS v FROM md GROUP BY base), dd AS (SELECT base, v.pub AS pub, v.codes AS codes FROM dm)"""


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "doc_metadata")
    base = F.coalesce(F.when(base_id("base_id") != "", base_id("base_id")), base_id("input_id"))
    rows = m.select(base.alias("base"), parse_date("publication_date").alias("pub"), parse_codes("cpc_subclasses").alias("codes"), "row_pos")
    return joins.last_values(rows, ["base"], ["pub", "codes"], "row_pos")


_QUERIES = f"qs AS (SELECT DISTINCT {BASE.format('patent_application_id')} AS app, {DATE.format('_date')} AS target FROM test WHERE label = 2), q2 AS (SELECT app, max(target) AS target FROM qs WHERE app <> '' AND target IS NOT NULL GROUP BY app)"


def _applications(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "test").where("label = 2").select(base_id("patent_application_id").alias("app"), parse_date("_date").alias("target")).where("app <> '' and target is not null")
    return rows.groupBy("app").agg(F.max("target").alias("target"))


def _shared(spark: SparkSession, folder: str, gone: DataFrame | None) -> DataFrame:
    """``app``, ``candidates`` > 0: the documents that share a code with an application and are dated before it, less those in ``gone`` (``app``, ``base``).

    Documents are numbered for their blocks; no pair of application and document is made."""
    d = cut(_documents(spark, folder))
    items = global_sequence(d.where("pub is not null and size(codes) > 0"), ["base"], "cand").withColumn("split", F.lit(""))
    apps = _applications(spark, folder).join(d.select(F.col("base").alias("app"), "codes"), "app").select(F.lit("").alias("split"), F.col("app").alias("claim_id"), "target", "codes")
    index, numbers = eligible.numbered(items, [F.col("codes"), F.array("base")])
    barred = None if gone is None else gone.select(F.lit("").alias("split"), F.col("app").alias("claim_id"), F.lit(1).alias("kind"), F.col("base").alias("value")).where("value is not null")
    counts = eligible.counts(eligible.asked(apps, "codes", 0, barred, numbers), index)
    return counts.groupBy(F.col("claim_id").alias("app")).agg(F.sum("n").alias("candidates"))


@query(f"""WITH {_META}, {_QUERIES}, u AS (SELECT app, target, unnest(codes) AS code FROM q2 JOIN dd ON base = app), c AS (SELECT DISTINCT base, pub, unnest(codes) AS code FROM dd)
    SELECT app, count(*) AS candidates FROM (SELECT DISTINCT app, base FROM u JOIN c USING (code) WHERE pub < target) GROUP BY app""")
def j09_set_overlap_before_date(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that share a code with an application and were published strictly before its date (j10's residual)."""
    return _shared(spark, folder, None)


@query(f"WITH {_META}, {_QUERIES} SELECT app, target, (SELECT count(*) FROM dd WHERE pub < target) AS earlier FROM q2")
def j10_strictly_before(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents were published strictly before each application's date: a range join as running counts."""
    return joins.count_before(_applications(spark, folder), "target", _documents(spark, folder), "pub", "earlier")


_SHARED = f"""u AS (SELECT app, target, unnest(codes) AS code FROM q2 JOIN dd ON base = app), c AS (SELECT DISTINCT base, pub, unnest(codes) AS code FROM dd), sh AS (SELECT DISTINCT app, base FROM u JOIN c USING (code) WHERE pub < target)"""


@query(f"""WITH {_META}, {_QUERIES}, {_SHARED}, ro AS (SELECT {BASE.format('patent_application_id')} AS app, {NORM.format('text')} AS q, {BASE.format('cited_document_id')} AS base, label FROM test),
    rf AS (SELECT coalesce(nullif({BASE.format('base_id')}, ''), {BASE.format('input_id')}) AS app, {REFERENCES.format('reference_bases')} AS refs, row_pos FROM doc_metadata),
    gone AS (SELECT app, base FROM ro WHERE label <> 2 UNION SELECT x.app, y.base FROM ro x JOIN ro y ON x.q = y.q AND x.label = 2 AND y.label <> 2 UNION SELECT app, unnest(refs) FROM (SELECT app, arg_max(refs, row_pos) AS refs FROM rf GROUP BY app))
    SELECT app, count(*) AS candidates FROM sh WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.app = sh.app AND g.base = sh.base) GROUP BY app""")
def j11_exclusion_sets(spark: SparkSession, folder: str) -> DataFrame:
    """j09's pairs without what the application cites, what a row with the text of one of its claims cites, and its references."""
    rows = table(spark, folder, "test").select("label", base_id("patent_application_id").alias("app"), F.md5(normalize_text("text")).alias("q"), base_id("cited_document_id").alias("base"))
    cited = rows.where("label <> 2")
    by_query = rows.where("label = 2").select("app", "q").distinct().join(cited.select("q", "base").distinct(), "q")
    m = table(spark, folder, "doc_metadata")
    base = F.coalesce(F.when(base_id("base_id") != "", base_id("base_id")), base_id("input_id"))
    refs = joins.last_values(m.select(base.alias("app"), parse_references("reference_bases").alias("refs"), "row_pos"), ["app"], ["refs"], "row_pos").select("app", F.explode("refs").alias("base"))
    gone = cited.select("app", "base").union(by_query.select("app", "base")).union(refs)
    return _shared(spark, folder, gone)


@query(f"""SELECT h._row_id AS hard_id, r._row_id AS random_id FROM test h JOIN generate_random_u r ON h.claim_id = r.claim_id AND h.label = 2
    WHERE coalesce(h._u_candidate_base, '') <> coalesce(r._u_candidate_base, '') AND {NORM.format('h.text_b')} <> {NORM.format('r.text_b')} AND coalesce(h._u_candidate_component, '') <> coalesce(r._u_candidate_component, '')""")
def j12_differs_from_hard(spark: SparkSession, folder: str) -> DataFrame:
    cols = lambda p: [F.col("claim_id"), F.col("_row_id").alias(f"{p}_id"), *[F.coalesce(c, F.lit("")).alias(f"{p}{i}") for i, c in enumerate((F.col("_u_candidate_base"), normalize_text("text_b"), F.col("_u_candidate_component")))]]
    hard, random = table(spark, folder, "test").where("label = 2").select(*cols("hard")), table(spark, folder, "generate_random_u").select(*cols("random"))
    return hard.join(random, "claim_id").where("hard0 <> random0 and hard1 <> random1 and hard2 <> random2").select("hard_id", "random_id")


@query("SELECT key, max(flag) AS flag FROM (SELECT claim_id AS key, max(label) OVER (PARTITION BY claim_id) AS flag FROM test UNION ALL SELECT lower(claim_id), max(label) OVER (PARTITION BY claim_id) FROM test) GROUP BY key")
def j13_alias_bridge(spark: SparkSession, folder: str) -> DataFrame:
    flags = table(spark, folder, "test").groupBy("claim_id").agg(F.max("label").alias("flag")).withColumn("other", F.lower("claim_id"))
    return joins.bridged_flags(flags, ["claim_id", "other"], "flag")


@query(f"SELECT _row_id, min(_row_id) OVER (PARTITION BY _u_candidate_base, {NORM.format('text_b')}) AS found FROM generate_random_u WHERE _u_candidate_base IS NOT NULL")
def j14_exact_pool_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The pool's entry for each row's document and passage."""
    r = table(spark, folder, "generate_random_u").where("_u_candidate_base is not null").select("_row_id", F.col("_u_candidate_base").alias("base"), normalize_text("text_b").alias("passage"))
    pool = r.groupBy("base", "passage").agg(F.min("_row_id").alias("found"))
    return r.join(pool, ["base", "passage"]).select("_row_id", "found")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS z FROM e),
    p AS (SELECT a.vec_id AS query_id, b.vec_id AS corpus_id, round(list_inner_product(a.v, b.v) / (a.z * b.z), 6) AS similarity FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
    SELECT query_id, corpus_id, similarity FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, corpus_id) = 1""")
def j15_nearest(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return vectors.nearest(e.where("vec_id % 100 = 0"), "vec_id", "embedding", e, "vec_id", "embedding").withColumn("similarity", F.round("similarity", 6))


@query("""WITH f AS (SELECT claim_id, _row_id, label, ln(1 + length(coalesce(text_b, ''))) AS f1, length(coalesce(text_b, '')) / length(text) AS f2 FROM test),
    s AS (SELECT avg(f1) AS m1, stddev_samp(f1) AS s1, avg(f2) AS m2, stddev_samp(f2) AS s2 FROM f), z AS (SELECT claim_id, _row_id, label, (f1 - m1) / s1 AS z1, (f2 - m2) / s2 AS z2 FROM f, s),
    d AS (SELECT a.claim_id, a._row_id AS id, b._row_id AS match, greatest(abs(a.z1 - b.z1), abs(a.z2 - b.z2)) AS distance FROM z a JOIN z b ON a.claim_id = b.claim_id AND a.label = 2 AND b.label <> 2)
    SELECT claim_id, id, match, round(distance, 6) AS distance FROM d WHERE distance <= 0.5 QUALIFY row_number() OVER (PARTITION BY claim_id, id ORDER BY distance, match) = 1""")
def j16_caliper_match(spark: SparkSession, folder: str) -> DataFrame:
    size = F.length(F.coalesce("text_b", F.lit("")))
    f = table(spark, folder, "test").select("claim_id", "_row_id", "label", F.log1p(size).alias("f1"), (size / F.length("text")).alias("f2"))
    s = f.agg(F.avg("f1").alias("m1"), F.stddev_samp("f1").alias("s1"), F.avg("f2").alias("m2"), F.stddev_samp("f2").alias("s2")).first()
    out = joins.caliper_match(f, "claim_id", F.col("label") == 2, "_row_id", {"f1": (s.m1, s.s1), "f2": (s.m2, s.s2)}, 0.5)
    return out.withColumn("distance", F.round("distance", 6))


@query("WITH d AS (SELECT event_id, ts::DATE AS day FROM events) SELECT event_id, round((rank() OVER (ORDER BY day) + (count(*) OVER (PARTITION BY day) - 1) / 2.0) / count(*) OVER (), 9) AS pct FROM d")
def w01_percentile_rank(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "events").select("event_id", F.col("ts").cast("date").alias("day"))
    return ranking.percentile_ranks(d, "day").select("event_id", F.round("pct", 9).alias("pct"))


_PCT = "SELECT event_id, day, (rank() OVER (ORDER BY day) + (count(*) OVER (PARTITION BY day) - 1) / 2.0::DOUBLE) / count(*) OVER () AS pct FROM (SELECT event_id, ts::DATE AS day FROM events)"


@query(f"WITH p AS ({_PCT}) SELECT event_id, CASE WHEN pct <= 1.0::DOUBLE / 3 THEN 'early' WHEN pct <= 2.0::DOUBLE / 3 THEN 'middle' ELSE 'late' END AS bin FROM p")
def w02_tertiles(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "events").select("event_id", F.col("ts").cast("date").alias("day"))
    return ranking.percentile_ranks(d, "day").select("event_id", ranking.tertile("pct").alias("bin"))


@query(f"WITH {METRICS} SELECT seed, _row_id, rank() OVER (PARTITION BY seed ORDER BY cited) + (count(*) OVER (PARTITION BY seed, cited) - 1) / 2.0::DOUBLE AS mid_rank FROM m")
def w03_mid_rank(spark: SparkSession, folder: str) -> DataFrame:
    s = scored_metrics(spark, folder).select("seed", "_row_id", "cited")
    g = running(s.groupBy("seed", "cited").agg(F.count("*").alias("n")), ["seed"], ["cited"], {"below": "n"})
    return s.join(g, ["seed", "cited"]).select("seed", "_row_id", (F.col("below") + (F.col("n") + 1) / F.lit(2.0)).alias("mid_rank"))


@query(f"WITH {METRICS} SELECT seed, _row_id, sum((label <> 2)::INT) OVER (PARTITION BY seed ORDER BY cited DESC, _row_id ROWS UNBOUNDED PRECEDING)::BIGINT AS hits FROM m")
def w04_cumulative_hits(spark: SparkSession, folder: str) -> DataFrame:
    s = scored_metrics(spark, folder).select("seed", "_row_id", "cited", (F.col("label") != 2).cast("int").alias("y"))
    return running(s, ["seed"], [("cited", "desc"), "_row_id"], {"before": "y"}).select("seed", "_row_id", (F.col("before") + F.col("y")).alias("hits"))


@query(f"WITH {METRICS} SELECT seed, query, _row_id, rank() OVER (PARTITION BY seed, query ORDER BY p_a DESC) AS rank FROM m")
def w05_strict_rank(spark: SparkSession, folder: str) -> DataFrame:
    scores = scored_metrics(spark, folder).select("seed", "query", "_row_id", "p_a", F.struct("seed", "query").alias("of"))
    return vectors.strict_rank(scores, "of", "p_a").select("seed", "query", "_row_id", "rank")


@query(f"WITH {METRICS}, b AS (SELECT query, max(p_a) AS best FROM m GROUP BY 1) SELECT query, sum((abs(best - p_a) <= 0.01)::INT)::BIGINT AS ties FROM m JOIN b USING (query) GROUP BY query")
def w06_count_best(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.count_best(scored_metrics(spark, folder), "query", "p_a", 0.01)


@query(f"WITH u AS (SELECT {BASE.format('cited_document_id')} AS base, {NORM.format('text_b')} AS passage, min(_row_id) AS first FROM test GROUP BY 1, 2) SELECT base, passage, first, row_number() OVER (ORDER BY first, base, passage) - 1 AS index FROM u")
def w07_first_appearance(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "test").select(F.coalesce(base_id("cited_document_id"), F.lit("")).alias("base"), normalize_text("text_b").alias("passage"), "_row_id")
    return ranking.first_appearance(rows, ["base", "passage"], "_row_id")


@query(f"SELECT _row_id, label FROM (SELECT *, row_number() OVER (PARTITION BY _row_id ORDER BY label, {NORM.format('text_b')}) AS r FROM quarantine) WHERE r = 1")
def w08_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "quarantine").select("_row_id", "label", normalize_text("text_b").alias("passage"))
    return joins.first_rows(rows, ["_row_id"], ["label", "passage"]).select("_row_id", "label")


@query(f"SELECT coalesce(nullif({BASE.format('base_id')}, ''), {BASE.format('input_id')}) AS base, max(row_pos) AS row_pos, arg_max(coalesce(status, '-'), row_pos) AS status FROM doc_metadata GROUP BY 1")
def w09_keep_last(spark: SparkSession, folder: str) -> DataFrame:
    base = F.coalesce(F.when(base_id("base_id") != "", base_id("base_id")), base_id("input_id"))
    rows = table(spark, folder, "doc_metadata").select(base.alias("base"), "row_pos", F.coalesce("status", F.lit("-")).alias("status"))
    return joins.last_values(rows, ["base"], ["row_pos", "status"], "row_pos")


@query("WITH p AS (SELECT n_nationkey, n_regionkey, ((n_nationkey * 7 % 25) + 1) / 500.0::DOUBLE AS p FROM nation), r AS (SELECT *, row_number() OVER (ORDER BY p, n_nationkey) AS k, count(*) OVER () AS n FROM p) SELECT n_nationkey, round(least(1.0, max((n - k + 1) * p) OVER (ORDER BY p, n_nationkey ROWS UNBOUNDED PRECEDING)), 9) AS adjusted FROM r")
def w10_running_max(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "nation").select("n_nationkey", ((F.col("n_nationkey") * 7 % 25 + 1) / F.lit(500.0)).alias("p"))
    return holm(p, [], "p", "n_nationkey").select("n_nationkey", F.round("p_adjusted", 9).alias("adjusted"))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    p AS (SELECT a.vec_id AS query, b.vec_id AS candidate, round(list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)), 6) AS score FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
    SELECT query, candidate, score FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) = 1""")
def k01_top1_cosine(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    best = vectors.nearest(e.where("vec_id % 100 = 0"), "vec_id", "embedding", e, "vec_id", "embedding", within="label", digits=6)
    return best.select(F.col("query_id").alias("query"), F.col("corpus_id").alias("candidate"), F.col("similarity").alias("score"))


@query("SELECT _row_id, (('0x' || substr(sha256('42|test|' || patent_application_id || '|' || claim_id), 1, 16))::UBIGINT % (label + 107))::BIGINT AS chosen FROM test WHERE patent_application_id IS NOT NULL")
def k02_deterministic_choice(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "test").where("patent_application_id is not null")
    return rows.select("_row_id", H.choice(F.col("label") + 107, F.lit("42"), F.lit("test"), F.col("patent_application_id"), F.col("claim_id")).alias("chosen"))


@query("SELECT row_number() OVER (ORDER BY label, claim_id DESC NULLS LAST, _row_id) - 1 AS place, _row_id FROM test")
def k03_stable_sort(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "test").select("label", "claim_id", "_row_id")
    return global_sequence(rows, ["label", ("claim_id", "desc"), "_row_id"], "place").select("place", "_row_id")


@query("SELECT _row_id, round(('0x' || substr(md5('42|' || _row_id), 1, 12))::UBIGINT / 281474976710656.0::DOUBLE, 9) AS score FROM test")
def k04_seeded_scores(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.seeded_scores(table(spark, folder, "test"), "_row_id", 42).select("_row_id", F.round("score", 9).alias("score"))


@query(f"WITH q AS (SELECT claim_id AS query, row_number() OVER (ORDER BY claim_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT claim_id FROM test)), d AS (SELECT replicate, (('0x' || substr(md5('42|' || replicate || '|' || i), 1, 12))::UBIGINT % n)::BIGINT AS i FROM q, (SELECT unnest(range(2000))::INT AS replicate)) SELECT replicate, query, count(*) AS w FROM d JOIN q USING (i) GROUP BY ALL")
def k05_bootstrap_draw(spark: SparkSession, folder: str) -> DataFrame:
    """How often each query is drawn in each of 2,000 replicates."""
    q = table(spark, folder, "test").select(F.col("claim_id").alias("query"))
    return resample.weights(resample.numbered_queries(q, "query"), "query", 2000, 42)


@query("WITH k AS (SELECT DISTINCT claim_id FROM test), n AS (SELECT claim_id, row_number() OVER (ORDER BY md5('42|' || claim_id), claim_id) - 1 AS n, count(*) OVER () AS t FROM k) SELECT claim_id, CASE WHEN n < t // 2 THEN 1 ELSE 2 END AS half FROM n")
def k06_half_assignment(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.half_assignment(table(spark, folder, "test"), "claim_id", 42)


@query("SELECT _row_id, label FROM test ORDER BY _row_id LIMIT 20")
def k07_preview(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "test").select("_row_id", "label").orderBy("_row_id").limit(20)


@query("SELECT _row_id, label FROM test UNION ALL SELECT _row_id, label FROM generate_random_u")
def o01_union_all(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "test").select("_row_id", "label").unionByName(table(spark, folder, "generate_random_u").select("_row_id", "label"))


@query("SELECT _row_id, label, NULL::INT AS _random_seed FROM test UNION ALL SELECT _row_id, label, _random_seed FROM generate_random_u")
def o02_union_missing(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "test").select("_row_id", "label").unionByName(table(spark, folder, "generate_random_u").select("_row_id", "label", "_random_seed"), allowMissingColumns=True)


@query("SELECT DISTINCT text AS value FROM train UNION SELECT DISTINCT text_b FROM train")
def o03_distinct_of_two(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "train")
    return t.select(F.col("text").alias("value")).union(t.select("text_b")).distinct()


_PREFIX = f"substr({BASE.format('cited_document_id')}, 1, 5) AS prefix"


@query("SELECT claim_id FROM test WHERE label <> 2 INTERSECT SELECT claim_id FROM test WHERE label = 2 INTERSECT SELECT claim_id FROM generate_random_u")
def o04_intersect3(spark: SparkSession, folder: str) -> DataFrame:
    """Whole keys: claims with cited, hard and random rows."""
    t = table(spark, folder, "test")
    return t.where("label <> 2").select("claim_id").intersect(t.where("label = 2").select("claim_id")).intersect(table(spark, folder, "generate_random_u").select("claim_id"))


@query("SELECT claim_id FROM test EXCEPT SELECT claim_id FROM generate_random_u")
def o05_except(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "test").select("claim_id").subtract(table(spark, folder, "generate_random_u").select("claim_id"))


_OV = f"""v AS (SELECT split, 'query' AS relation, {NORM.format('text')} AS value FROM {_PAIRS3} UNION ALL SELECT split, 'passage', {NORM.format('text_b')} FROM {_PAIRS3} UNION ALL SELECT split, 'document', {BASE.format('cited_document_id')} FROM {_PAIRS3}),
    d AS (SELECT DISTINCT split, relation, value FROM v WHERE value <> '')"""


@query(f"WITH {_OV} SELECT a.relation, a.split AS first, b.split AS second, count(*) AS shared FROM d a JOIN d b ON a.relation = b.relation AND a.value = b.value AND a.split < b.split GROUP BY ALL")
def o06_cross_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = load_splits(spark, folder, ["train", "validation", "test"], ["text", "text_b", "cited_document_id"])
    return audits.cross_split_overlaps(rows, "split", {"query": normalize_text("text"), "passage": normalize_text("text_b"), "document": base_id("cited_document_id")})
