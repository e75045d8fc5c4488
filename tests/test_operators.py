"""Hand-made cases and brute force for the operators."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairlab.operators import audits, bootstrap, candidates, inference, joins, metrics, ranking, resample, schema, vectors
from pairlab.operators.components import components
from pairlab.plans.sequence import global_running, global_sequence, running

from .compare import rows_of


def scored(spark, rows):
    return spark.createDataFrame(rows, "g string, q string, y int, s double, o int")


def one(df):
    r = df.collect()
    return r[0].value if r else None


def test_auc_ties_and_single_class(spark):
    tied = scored(spark, [("a", "q", 1, 0.5, 1), ("a", "q", 0, 0.5, 2)])
    assert one(metrics.roc_auc(tied, ["g"], F.col("y") == 1, "s")) == 0.5
    assert one(metrics.roc_auc(tied.where("y = 1"), ["g"], F.col("y") == 1, "s")) is None
    assert metrics.roc_auc(tied.limit(0), ["g"], F.col("y") == 1, "s").count() == 0
    assert one(metrics.average_precision(tied, ["g"], F.col("y") == 1, "s")) == 0.5


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 5), st.integers(1, 3)), min_size=2, max_size=30))
def test_auc_brute_force(spark, rows):
    df = spark.createDataFrame([("a", y, s / 5, w) for y, s, w in rows], "g string, y int, s double, w int")
    pos, neg = [(s, w) for y, s, w in rows if y], [(s, w) for y, s, w in rows if not y]
    total = sum(w * v for _, w in pos for _, v in neg)
    expected = sum(w * v * ((s > t) + 0.5 * (s == t)) for s, w in pos for t, v in neg) / total if total else None
    for by in (["g"], []):
        got = one(metrics.roc_auc(df, by, F.col("y") == 1, "s", "w"))
        assert got == expected or abs(got - expected) < 1e-9


def test_pairwise_mrr_ndcg(spark):
    df = scored(spark, [("a", "q", 1, 0.6, 1), ("a", "q", 1, 0.4, 2), ("a", "q", 0, 0.4, 3)])
    better, worse = F.col("y") == 1, F.col("y") == 0
    assert one(metrics.pairwise_by_query(df, ["g"], "q", better, worse, "s")) == 0.75
    assert one(metrics.single_pairwise(df, ["g"], "q", better, worse, "s")) == 0.75
    first = scored(spark, [("a", "q", 0, 0.9, 1), ("a", "q", 1, 0.9, 2)])
    assert one(metrics.reciprocal_rank_by_query(first, ["g"], "q", better, "s", "o")) == 0.5
    ideal = scored(spark, [("a", "q", 2, 0.9, 1), ("a", "q", 1, 0.5, 2), ("a", "q", 0, 0.1, 3)])
    assert one(metrics.ndcg_linear_by_query(ideal, ["g"], "q", F.col("y"), "s")) == pytest.approx(1.0)
    assert one(metrics.ndcg_by_query(ideal, ["g"], "q", F.col("y"), "s", "o")) == pytest.approx(1.0)


def test_f1_of_absent_class(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", None, 1)], "g string, y int, p int")
    got = {r.metric: r.value for r in metrics.accuracy_f1(df, ["g"], "y", "p").collect()}
    assert got == {"accuracy": 1.0, "f1_0": 1.0, "f1_1": 0.0, "f1_2": 0.0, "macro_f1": pytest.approx(1 / 3)}


def test_holm_and_tail(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "n string, p double")
    got = {r.n: r.p_adjusted for r in inference.holm(p, [], "p", "n").collect()}
    assert got["d"] is None and [round(got[k], 9) for k in "abc"] == [0.03, 0.06, 0.06]
    d = spark.range(2000).select(F.lit("x").alias("g"), (F.col("id") + 1.0).alias("d"))
    assert inference.tail_p(d, ["g"], "d").first().p_value == pytest.approx(2 / 2001)


def test_tertiles_of_one_day(spark):
    df = spark.createDataFrame([(i, 5) for i in range(6)] + [(9, None)], "i int, d int")
    got = {r.i: (r.pct, r.bin) for r in ranking.percentile_ranks(df, "d").withColumn("bin", ranking.tertile("pct")).collect()}
    assert got[0] == (pytest.approx(3.5 / 6), "middle") and got[9] == (None, None)


def test_half_assignment(spark):
    df = spark.createDataFrame([(f"q{i}",) for i in range(9)] + [("q1",), (None,)], "k string")
    halves = [r.half for r in ranking.half_assignment(df, "k", 1).collect()]
    assert (halves.count(1), halves.count(2)) == (4, 5)


def test_sequence_and_running(spark):
    rows = [(i, random.Random(i).randint(0, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, v int")
    got = global_sequence(df, ["v", ("i", "desc")]).orderBy("seq").collect()
    assert [(r.v, -r.i) for r in got] == sorted((v, -i) for i, v in rows) and [r.seq for r in got] == list(range(200))
    total, before = 0, {r.i: r.t for r in global_running(df, ["i"], {"t": "v"}).collect()}
    for i, v in rows:
        assert before[i] == total
        total += v
    got = running(df.withColumn("g", F.when(F.col("i") % 3 > 0, F.col("i") % 3)), ["g"], ["i"], {"t": "v", "n": None}).collect()
    for r in got:
        before = [v for i, v in rows if i % 3 == (r.g or 0) and i < r.i]
        assert (r.t, r.n) == (sum(before), len(before))
    assert global_sequence(df.limit(0), ["v", "i"]).count() == 0


def brute_components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(parent)}


@pytest.mark.parametrize("small", [0, 1000])
def test_components(spark, small):
    r = random.Random(3)
    edges = [(f"n{r.randint(0, 80):03d}", f"n{r.randint(0, 80):03d}") for _ in range(45)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(30)] + [("hub", f"l{i}") for i in range(60)]
    edges += [("x", "x"), ("x", None), (None, "y"), ("hub", "l1"), ("l1", "hub")]
    df = spark.createDataFrame([(a, b, 1) for a, b in edges], "u string, v string, label int")
    assert {(x.node, x.component) for x in components(df, "u", "v", small_graph=small).collect()} == brute_components(edges)
    assert components(df.limit(0), "u", "v").count() == 0


def test_cross_split(spark):
    df = spark.createDataFrame([("train", "a"), ("train", "a"), ("test", "a"), ("test", "b"), ("test", None), ("validation", "c")], "split string, v string")
    r = audits.cross_split_statistics(df, "split", {"v": F.col("v")}).first()
    assert (r.shared_values, r.rows_affected, r.contaminated_rows, r.test_rows, r.contamination) == (1, 3, 1, 2, 0.5)
    assert rows_of(audits.cross_split_overlaps(df, "split", {"v": F.col("v")}), ["relation", "first", "second", "shared"]) == [("v", "test", "train", 1)]
    assert audits.cross_split_overlaps(df.limit(0), "split", {"v": F.col("v")}).count() == 0


def test_cleaning(spark):
    rows = [(1, "a", "b", 0), (2, "A ", "b", 1), (3, "c", "d", 0), (4, "c", "D", 0), (5, None, "d", 0)]
    got = {r.i: r.reason for r in audits.clean_pairs(spark.createDataFrame(rows, "i int, t string, p string, y int"), "t", "p", "y", ["i"]).collect()}
    assert got == {1: "conflicting_label", 2: "conflicting_label", 3: None, 4: "duplicate", 5: None}


def test_joins(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "k int, y int")
    with pytest.raises(ValueError):
        joins.one_to_one(a, a.union(a), "k")
    with pytest.raises(ValueError):
        joins.one_to_one(a, a.withColumn("y", F.lit(0)), "k", agree="y")
    with pytest.raises(ValueError):
        schema.require_columns(a, ["z"])
    assert schema.resolve_columns(a, {"key": ["K "]}) == {"key": "k"}
    l = spark.createDataFrame([("x", ["a", "b"], 1), ("y", None, 2), ("z", [], 3)], "l string, s array<string>, d int")
    r = spark.createDataFrame([("p", ["b", "a"], 2), ("q", ["a"], 0)], "r string, t array<string>, e int")
    assert {r.k: r.n for r in joins.count_before(a.union(spark.createDataFrame([(None, 5)], "k int, y int")), "k", a.union(a), "k", "n").collect()} == {1: 0, 2: 2, None: None}
    assert rows_of(joins.sharing(l, "l", "s", r, "r", "t", F.col("e") > F.col("d")), ["l", "r"]) == [("x", "p")]
    f = spark.createDataFrame([("q", "u", True, 1.0), ("q", "b", False, 3.0), ("q", "a", False, 3.0), ("q", "c", False, None)], "q string, i string, t boolean, f double")
    assert [tuple(x) for x in joins.caliper_match(f, "q", F.col("t"), "i", {"f": (0.0, 2.0)}, 1.0).collect()] == [("q", "u", "a", 1.0)]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [2.0, 0.0]), (5, [1.0, 0.0])], "i long, v array<double>")
    got = {r.query_id: (r.corpus_id, r.similarity) for r in vectors.nearest(df, "i", "v", df, "i", "v", block=2).collect()}
    assert got == {1: (4, 1.0), 4: (1, 1.0), 5: (1, 1.0)}
    assert vectors.nearest(df.limit(0), "i", "v", df, "i", "v").count() == 0
    near = df.withColumn("g", F.when(F.col("i") == 5, "b").when(F.col("i") < 5, "a"))
    assert {r.query_id: r.corpus_id for r in vectors.nearest(near, "i", "v", near, "i", "v", within="g").collect()} == {1: 4, 4: 1}
    best = spark.createDataFrame([("q", 2, 0.5), ("q", 1, 0.5), ("q", 3, 0.4)], "q string, c int, s double")
    assert tuple(vectors.best_by_query(best, "q", "c", "s").first()) == ("q", 1, 0.5)


def test_bootstrap_weights(spark):
    q = spark.createDataFrame([(f"q{i}",) for i in range(7)], "q string")
    w = resample.weights(resample.numbered_queries(q, "q"), "q", 5, 1)
    assert {r[0]: r[1] for r in w.groupBy("replicate").agg(F.sum("w")).collect()} == {b: 7 for b in range(5)}
    n = resample.numpy_weights(spark, [f"q{i}" for i in range(7)], "q", 2, 1)
    assert n.agg(F.sum("w")).first()[0] == 14


def test_replicates_by_weight_vectors(spark):
    """As the relation of resampled rows gives them, with ties over partitions, nulls, and a group with one class."""
    rows = spark.range(600).select((F.col("id") % 3).cast("int").alias("seed"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("g"), F.col("id") % 2)).alias("bin"), F.concat(F.lit("q"), F.col("id") % 37).alias("query"), F.when(F.col("id") % 101 > 0, F.col("id") % 4).cast("int").alias("label"), F.when(F.col("id") % 97 > 0, F.pmod(F.xxhash64("id"), F.lit(9)) / F.lit(10.0)).alias("score"), F.when(F.col("id") % 2 == 0, 2).otherwise(1).alias("predicted"))
    rows = rows.unionByName(rows.where("seed = 0 and label <> 2").withColumn("seed", F.lit(7)))
    numbered = resample.numbered_queries(rows, "query")
    relation = resample.resampled(rows, resample.weights(numbered, "query", 30, 5), "query")
    w = bootstrap.weight_vectors(numbered, "query", 30, 5)
    known = F.col("label").isNotNull()
    expected = metrics.roc_auc(relation.where(known), ["seed", "bin", "replicate"], F.col("label") != 2, "score", "w").drop("metric")
    got = bootstrap.replicate_auc(rows, ["seed", "bin"], "query", F.col("label") != 2, "score", w, 30)
    assert rows_of(got, ["seed", "bin", "replicate", "value"]) == rows_of(expected, ["seed", "bin", "replicate", "value"])
    f1 = bootstrap.replicate_f1(rows, ["seed"], "query", "label", "predicted", w, 30).select("seed", "replicate", "accuracy", "macro_f1")
    plain = metrics.accuracy_f1(relation, ["seed", "replicate"], "label", "predicted", weight="w").where("metric in ('accuracy', 'macro_f1')").groupBy("seed", "replicate").pivot("metric").agg(F.first("value"))
    assert rows_of(f1, ["seed", "replicate", "accuracy", "macro_f1"]) == rows_of(plain, ["seed", "replicate", "accuracy", "macro_f1"])
    per = rows.groupBy("seed", "query").agg(F.avg("score").alias("v"))
    mean = bootstrap.replicate_mean(per, ["seed"], "query", "v", w, 30)
    both = resample.resampled(per, resample.weights(numbered, "query", 30, 5), "query").groupBy("seed", "replicate").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("value"))
    assert rows_of(mean, ["seed", "replicate", "value"]) == rows_of(both, ["seed", "replicate", "value"])
    none = rows.limit(0)
    assert bootstrap.replicate_auc(none, ["seed"], "query", F.col("label") != 2, "score", bootstrap.weight_vectors(resample.numbered_queries(none, "query"), "query", 30, 5), 30).count() == 0


def chain_tables(spark):
    """One claim, its application, and documents of which each breaks one rule; D9 breaks none."""
    pairs = [("r1", "c1", "APP1", "D1", "claim", "own passage", 2, "2020-01-01", "t"), ("r2", "c1", "APP1", "D2", "claim", "cited passage", 0, "2020-01-01", "t")]
    pairs += [(f"s{i}", f"x{i}", f"APPX{i}", f"D{i}", f"text {i}", f"passage {i}", 1, "2020-01-01", f"k{i}") for i in (1, 3, 4, 5, 6, 9)]
    pairs += [("s7", "x7", "APPX7", "D7", "text 7", "passage 7", 1, "2020-01-01", "t"), ("s8", "x8", "APPX8", "D8", "text 8", "own passage", 1, "2020-01-01", "k8"), ("s0", "x0", "APPX0", "D2", "text 0", "passage 0", 1, "2020-01-01", "k0")]
    columns = ["_row_id", "claim_id", "patent_application_id", "cited_document_id", "text", "text_b", "label", "_date", "_u_target_component"]
    df = spark.createDataFrame(pairs, columns).withColumns({"label": F.col("label").cast("int"), "split": F.lit("test"), "date": F.lit(None).cast("string"), "_parsed_date": F.lit(None).cast("timestamp"), "_u_candidate_base": F.lit(None).cast("string"), "_priority_component_id": F.col("_u_target_component")})
    meta = [(0, "APP1", "20190101", "A01B, B02C", "D3"), *[(i, f"D{i}", "20180101", "A01B", "") for i in (1, 2, 3, 6, 7, 8, 9)], (14, "D4", "20210101", "A01B", ""), (15, "D5", "20180101", "C03D", ""), *[(20 + i, f"APPX{i}", None, "", "") for i in range(10)]]
    return df, spark.createDataFrame([(p, i, i, d, c, r) for p, i, d, c, r in meta], "row_pos long, input_id string, base_id string, publication_date string, cpc_subclasses string, reference_bases string")


def test_pool_and_planted_violations(spark):
    chain = candidates.Chain(*chain_tables(spark))
    told = {r.cand: r.base for r in chain.cands.collect()}
    assert sorted(told[r.cand] for r in chain.pool().where("claim_id = 'c1'").collect()) == ["D6", "D9"]
    assert {r.claim_id: r.n for r in chain.sizes.collect()} == {"c1": 2}
    chosen = chain.random().collect()
    assert len(chosen) == 1 and chosen[0].candidate_base in ("D6", "D9") and chosen[0].pool_size == 2
    clean = {r["check"]: r["count"] for r in candidates.violations(chain.random(), chain.targets, chain.prep, chain.docs).collect()}
    assert set(clean.values()) == {0} and set(clean) == set(candidates.CHECKS)
    planted = spark.createDataFrame([("test", "c1", d, t) for d, t in (("D9", "passage 9"), ("D8", "own passage"), ("D1", "passage 1"), ("D2", "passage 0"), ("D3", "passage 3"), ("D4", "passage 4"), ("D5", "passage 5"), ("D7", "passage 7"), ("D9", "passage 9"))], "split string, claim_id string, candidate_base string, text_b string")
    got = {r["check"]: r["count"] for r in candidates.violations(planted, chain.targets, chain.prep, chain.docs).collect()}
    assert got == {"duplicate_queries": 8, "duplicate_query_passage_pairs": 1, "same_as_hard_u_passage": 1, "same_as_hard_u_document": 1, "existing_citation_or_reference": 2, "time_violation": 1, "cpc_violation": 1, "same_component_violation": 1}
    df, meta = chain_tables(spark)
    assert candidates.Chain(df.limit(0), meta).random().count() == 0 and candidates.Chain(df, meta.limit(0)).pool().count() == 0
